"""Approximate nearest neighbours by a forest of sorted hash strings (longest-prefix matches), largest cosine first.

Each of `TREES` trees gives every vector a string of 64 bits, the signs of 64 random projections, and holds the strings in sorted
order. A query descends each tree to its longest-prefix matches; then all trees ascend together, one bit at a time,
until the strings that share so long a prefix number `enough` over all trees. All vectors below that depth are candidates, none is
capped; their cosines are exact, in double precision on the original vectors.

The forest is built once, in shards of about `SHARD` vectors (by a hash of their ids), and written to the shared folder with its
sorted arrays. The queries, a stated set, are written there with their strings, in blocks of `QUERIES`. One job then reads each
shard once and every block for it; a task holds the shards of one Arrow batch and one block, whatever their numbers.

How many strings of a shard are enough depends on the data (vectors without clusters need a large share of them), so it is
measured: for `SAMPLE` queries the true neighbours are found by brute force, and `enough` is the least number with which the
forest finds `RECALL` of them. That sample is a bound on fitting only; every vector is indexed and every query searched.

Equal vectors are one entry with their k + 1 smallest ids (k neighbours and the query itself), so copies cost nothing.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, and neither do vectors
whose length isn't the most frequent one (ties: the smaller length); null ids take no part; rows that repeat a vec_id
and its vector are one, other repeats of a vec_id are queries and candidates of their own, but not of a query with that id; components may be as small or large as a
double holds (both vectors of a cosine are scaled by powers of two, which changes no digit); an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, join_hot, materialize, new_dir, open_fs, own_columns, temporary, write_atomically

TREES, BITS = 12, 64
SHARD, QUERIES, SAMPLE = 4096, 4096, 128
RECALL = 0.96
CLOSE = 1e-9  # scores that rounding could put in another order


def projections(dimensions: int, tree: int) -> np.ndarray:
    return np.random.default_rng([20_240, tree]).standard_normal((dimensions, BITS))


def strings(vectors: np.ndarray, trees: int = TREES) -> np.ndarray:
    """(trees, vectors) hash strings as unsigned 64-bit numbers, the first projection in the highest bit."""
    powers = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.stack([((vectors @ projections(vectors.shape[1], t)) >= 0).astype(np.uint64) @ powers for t in range(trees)])


def spans(array: np.ndarray, queries: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in a sorted array, of the strings that share the first `depth` bits with each query: by binary search."""
    free = np.uint64(BITS) - np.clip(depth, 1, BITS).astype(np.uint64)
    keep = np.where(depth <= 0, np.uint64(0), (~np.uint64(0) >> free) << free)
    low = queries & keep
    return np.searchsorted(array, low, "left"), np.searchsorted(array, low | ~keep, "right")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bits."""
    differ = a ^ b
    bits = np.zeros(differ.shape, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = differ >> np.uint64(step) != 0
        bits += high * step
        differ = np.where(high, differ >> np.uint64(step), differ)
    return BITS - (bits + (differ != 0))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v of the vectors that take part."""
    own = own_columns(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), "v")
    good = own.where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return good.join(F.broadcast(usual.select("n")), F.size("v") == F.col("n")).select("id", "v")  # one row


def _unit(vectors: np.ndarray) -> np.ndarray:
    found = vectors.astype(np.float64)
    found *= np.exp2(-np.clip(np.floor(np.log2(np.abs(found).max(axis=1))), -1000, 1000))[:, None]
    return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


SHARDS = "shard int, n int, c binary, v binary, kind string, sorted binary, places binary"
FOUND = pa.schema([("c", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])


def _build(own: pd.DataFrame) -> pd.DataFrame:
    """One row of a shard: ids, vectors, and for each tree the sorted strings and whose they are."""
    own = own.sort_values("c")
    v = np.stack(own["v"].to_list())
    s = strings(_unit(v))
    order = np.argsort(s, axis=1, kind="stable")
    return pd.DataFrame({"shard": [own["shard"].iloc[0]], "n": [len(own)], "c": [own["c"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()], "kind": [v.dtype.str], "sorted": [np.take_along_axis(s, order, 1).tobytes()], "places": [order.astype(np.int32).tobytes()]})


class Shard:
    """A part of the forest, and its search."""

    def __init__(self, n: int, c: bytes, v: bytes, kind: str, in_order: bytes, places: bytes):
        self.c = np.frombuffer(c, np.int64)
        self.v = _unit(np.frombuffer(v, kind).reshape(n, -1))
        self.sorted = np.frombuffer(in_order, np.uint64).reshape(-1, n)
        self.places = np.frombuffer(places, np.int32).reshape(-1, n)

    def counts(self, s: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many strings share the first `depth` bits with each query, over all trees."""
        return sum(np.subtract(*spans(array, of, depth)[::-1]) for array, of in zip(self.sorted, s))

    def depths(self, s: np.ndarray, enough: int) -> np.ndarray:
        """The largest depth at which `enough` strings share a prefix with each query; 0 if there are fewer."""
        low, high = np.zeros(s.shape[1], np.int64), np.full(s.shape[1], BITS)
        while (low < high).any():
            middle = (low + high + 1) // 2
            there = self.counts(s, middle) >= enough
            low, high = np.where(there, middle, low), np.where(there, high, middle - 1)
        return low

    def nearest(self, v: np.ndarray, s: np.ndarray, enough: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query's place, its k + 1 nearest candidates (more if they are close) and their scores."""
        both = [spans(array, of, depth) for depth in [self.depths(s, enough)] for array, of in zip(self.sorted, s)]
        begin, end = (np.stack(x, axis=1).tolist() for x in zip(*both))
        met = np.zeros(len(self.c), bool)
        for q in range(len(v)):
            met[:] = False
            for places, b, e in zip(self.places, begin[q], end[q]):
                met[places[b:e]] = True
            at = np.flatnonzero(met)
            if len(at):
                near = self.v[at] @ v[q]
                if len(at) > k + 1:
                    close = near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - CLOSE
                    at, near = at[close], near[close]
                yield q, self.c[at], near

    def true(self, c: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest by brute force, their scores, and how many strings are enough to find each: one more than share a longer prefix
        than the neighbour does in any tree."""
        near = v @ self.v.T
        near[c[:, None] == self.c[None, :]] = -2
        n = min(k, len(self.c))
        at = np.argpartition(-near, n - 1, axis=1)[:, :n]
        own = np.empty_like(self.sorted)
        np.put_along_axis(own, self.places.astype(np.int64), self.sorted, axis=1)
        prefix = common_prefix(s[:, :, None], own[:, at]).max(axis=0)
        wanted = np.stack([np.where(prefix[:, j] < BITS, self.counts(s, np.minimum(prefix[:, j] + 1, BITS)), 0) + 1 for j in range(n)], axis=1)
        return self.c[at], np.take_along_axis(near, at, axis=1), wanted


def _shards(batch: pa.RecordBatch) -> list[Shard]:
    return [Shard(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 7)))]


def _write_queries(asked: DataFrame, out_dir: str) -> DataFrame:
    """Blocks of queries as files (c, unit vectors, strings); returns the first class, count and path of each."""
    schema = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("path", pa.string())])

    def write(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("c")
        c, v = own["c"].to_numpy(np.int64), _unit(np.stack(own["v"].to_list()))
        path = f"{out_dir}/queries-{int(own['block'].iloc[0]):08d}.parquet"
        table = pa.table({"c": c, "v": [x.tobytes() for x in v], "s": [x.tobytes() for x in strings(v).T]})
        write_atomically(path, lambda stream: pq.write_table(table, stream))
        return pd.DataFrame({"first": [c[0]], "n": [len(c)], "path": [path]})

    return asked.groupBy("block").applyInPandas(write, ", ".join(f"{f.name} {'string' if f.name == 'path' else 'long'}" for f in schema))


def _read_queries(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    filesystem, path = open_fs(uri)
    table = pq.read_table(path, filesystem=filesystem)
    n = table.num_rows
    both = (np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(n, -1) for name, kind in (("v", np.float64), ("s", np.uint64)))
    v, s = both
    return table["c"].to_numpy(), v, np.ascontiguousarray(s.T)


def _enough(forest: DataFrame, sample: tuple, k: int, recall: float) -> int:
    """The least number of strings of a shard with which the forest finds `recall` of the sample's true neighbours."""
    shared = forest.sparkSession.sparkContext.broadcast(sample)
    schema = pa.schema([("c", pa.int64()), ("other", pa.int64()), ("score", pa.float64()), ("wanted", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v, s = shared.value
        for batch in batches:
            for shard in _shards(batch):
                other, score, wanted = shard.true(c, v, s, k)
                out = np.repeat(c, other.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[score.ravel() > -2]) for x in (out, other, score, wanted)], schema=schema)

    best = Window.partitionBy("c").orderBy(F.desc("score"), "wanted")
    true = forest.mapInArrow(run, "c long, other long, score double, wanted long").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    needs = sorted(r.wanted for r in true.select("wanted").collect())  # SAMPLE * k rows at most
    return needs[min(len(needs) - 1, math.ceil(recall * len(needs)))] if needs else 1


def _pairs(forest: DataFrame, blocks: list[str], enough: int, k: int) -> DataFrame:
    """c, other, score: the nearest candidates of every query, k + 1 (or all that are close) of each Arrow batch of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = _shards(batch)
            for path in blocks:
                c, v, s = _read_queries(path)
                found: list[list] = [[] for _ in c]
                for shard in shards:
                    for q, other, score in shard.nearest(v, s, enough, k):
                        found[q].append((other, score))
                out = []
                for q, parts in enumerate(found):
                    if parts:
                        other, score = (np.concatenate(x) for x in zip(*parts))
                        if len(score) > k + 1:
                            close = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1] - CLOSE
                            other, score = other[close], score[close]
                        out.append((np.full(len(other), c[q]), other, score))
                if out:
                    yield batch_of(dict(zip(FOUND.names, map(np.concatenate, zip(*out)))), FOUND)

    return forest.mapInArrow(run, "c long, other long, score double")


def _cosine(a: str, b: str) -> tuple[Column, Column, Column]:
    """Two vectors scaled by powers of two, so that squares stay finite, and their cosine, summed in one fixed order, so that
    repeated runs give equal numbers."""

    def scaled(x: str) -> Column:
        exponent = F.floor(F.log2(F.array_max(F.transform(x, lambda y: F.abs(y.cast("double"))))))
        factor = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000), F.least(F.lit(1000), exponent)).cast("double"))
        return F.transform(x, lambda y: y.cast("double") * factor)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = F.col("x_"), F.col("y_")
    return scaled(a).alias("x_"), scaled(b).alias("y_"), dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    # A vector is known by two hashes of its components (128 bits), which are cheaper to sort by.
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.lit(1)).alias("h2")]
    members = usable(vectors, id_col, vector_col).select("id", "v", *same)
    # Each distinct vector once, with its smallest ids (a limit that each task applies before the shuffle); and the queries.
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = members.select("id", "h1", "h2").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    few = few.groupBy("h1", "h2").agg(F.min("id").alias("c"), F.array_sort(F.collect_list("id")).alias("ids"))
    grouped = materialize(members.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(few, ["h1", "h2"]), "ann-classes")
    asking = materialize(members.where(F.col("id") % every == 0).select(F.col("id").alias("q"), "h1", "h2").distinct(), "ann-asking")
    named = grouped.select("h1", "h2", "c").join(asking.groupBy("h1", "h2").agg(F.count("*").alias("n")), ["h1", "h2"])
    asked = materialize(join_hot(asking, named, ["h1", "h2"]).select("q", "c"), "ann-queries")
    # The forest and the queries, each written once.
    shards = max(1, -(-grouped.count() // SHARD))
    dealt = grouped.select("c", "v", F.pmod(F.xxhash64("c"), F.lit(shards)).cast("int").alias("shard"))
    forest = materialize(dealt.groupBy("shard").applyInPandas(_build, SHARDS), "ann-forest")
    classes = grouped.select("c", "v").join(asked.groupBy("c").agg(F.count("*").alias("n")), "c")
    classes = materialize(classes, "ann-asked")
    count = classes.count()
    if not count:
        return asked.select(F.col("q").alias("query_id"), F.lit(1).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    blocks = F.pmod(F.hash("c"), F.lit(-(-count // QUERIES))).alias("block")
    files = _write_queries(classes.select("c", "v", blocks), temporary(spark, new_dir(spark, "ann-blocks")))
    paths = sorted(r.path for r in files.collect())  # one name for QUERIES queries
    sampled = classes.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("c", "v").collect()
    v = _unit(np.array([r.v for r in sampled]))
    enough = _enough(forest, (np.array([r.c for r in sampled], np.int64), v, strings(v)), k, recall)
    pairs = _pairs(forest, paths, enough, k)
    # Each class has one id at least and k + 1 classes (with all that tie nearly) hold every answer.
    in_order = Window.partitionBy("c").orderBy(F.desc("score"), "other")
    edge = F.min(F.when(F.col("r") <= k + 1, F.col("score"))).over(Window.partitionBy("c"))
    kept = pairs.withColumn("r", F.row_number().over(in_order)).withColumn("edge", edge).where(F.col("score") >= F.col("edge") - CLOSE).select("c", "other")
    # Scores anew on the original vectors. A class's first k + 1 ids hold the k nearest of each of its queries.
    x, y, cosine = _cosine("a", "b")
    scored = kept.join(grouped.select("c", F.col("v").alias("a")), "c").join(grouped.select(F.col("c").alias("other"), F.col("v").alias("b"), "ids"), "other")
    scored = scored.select("c", "ids", x, y).select("c", cosine.alias("score"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("c").orderBy(F.desc("score"), "vec_id")
    lists = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    answered = join_hot(asked, materialize(classes.select("c", "n").join(lists, "c"), "ann-near"), "c")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("q")), 1, k)
    rows = answered.select(F.col("q").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
