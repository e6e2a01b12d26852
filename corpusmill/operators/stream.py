"""The corpus as one ordered token stream: offsets, splits, chunks, next-token samples, permutations and batches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_ids
from .names import reserve


def head(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first n documents in key order (a top-n: every task keeps n rows)."""
    return docs.orderBy(key).limit(n)


def byte_tokens(docs: DataFrame, end_id: int | None = None) -> DataFrame:
    """doc_id, ids: UTF-8 bytes as ids, and an end id."""
    ids = byte_ids(F.col("text"))
    return docs.select("doc_id", (ids if end_id is None else F.concat(ids, F.array(F.lit(end_id)))).alias("ids"))


def join_documents(docs: DataFrame, separator: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the separator behind it; their concatenation in key order is the corpus, never one string."""
    return docs.select(key, F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(separator)).alias("text"))


#: Ranges at most: their bounds are literals of one expression.
MOST_RANGES = 8192


def ranged(rows: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """`rows` with `range_` and `order_`: ranges that ascend in the order of key (nulls first), then a hash of the whole row.

    Bounds are quantiles of the key (a scan of one column). A key of so many rows that several bounds fall on it, or null, fills
    as many ranges, dealt by the upper bits of `order_`; so no key is too large for a range, unless whole rows are equal, which
    stay together.
    """
    reserve(rows, "range_", "order_")
    buckets = min(MOST_RANGES, buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    said = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets).alias("b"), F.count("*").alias("n"), F.count(key).alias("keys")).first()
    bounds = sorted(said.b or [])
    nulls = -(-buckets * (said.n - said.keys) // said.n) if said.n else 0
    deal = lambda times: F.least(F.floor((F.col("order_") / F.lit(2.0**64) + F.lit(0.5)) * times), times - F.lit(1))  # noqa: E731  from 0, ascending with order_
    times, own = Counter(bounds), F.col(key)
    hot = F.lit(None).cast("int")
    for v in (v for v in sorted(times, reverse=True) if times[v] > 1):
        hot = F.when(own == F.lit(v), F.lit(bounds.index(v) + 1 + nulls) + deal(F.lit(times[v]))).otherwise(hot)
    known = F.coalesce(hot, range_of(own, bounds) + F.lit(nulls))
    placed = F.when(own.isNull(), deal(F.lit(max(1, nulls)))).otherwise(known).cast("int")
    return rows.withColumn("order_", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).withColumn("range_", placed)


def _starts(placed: DataFrame) -> DataFrame:
    """range_, start_: the sum of n in all ranges before; a row a range."""
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("range_").agg(F.sum("n").alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).cast("long").alias("start_"))


def _numbered(placed: DataFrame, key: str) -> DataFrame:
    """`placed` with `offset`: one shuffle, by range; the ranges' sums come from a pass of their own and are broadcast, a row a range."""
    inside = Window.partitionBy("range_").orderBy(F.col(key).asc_nulls_first(), "order_").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("within_", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return numbered.join(F.broadcast(_starts(placed)), "range_").withColumn("offset", (F.col("start_") + F.col("within_")).cast("long")).drop("start_", "within_")


def offsets(sizes: DataFrame, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """`sizes` (key, n) with `offset`, the sum of n over all rows before: smaller keys (null is the smallest), and of equal keys
    those with the smaller row hash.

    Two levels: sums of ranges (one row a range, a window over those), then a window inside each range; no task sees all rows, nor
    all rows of one key: equal rows are counted first and take their places one after another. Null n adds nothing. The names that
    it adds may not be in `sizes`.
    """
    reserve(sizes, "range_", "order_", "start_", "within_", "offset", "n_", "copies_", "each_")
    counted = sizes.groupBy(*[F.col(f"`{c}`") for c in sizes.columns]).agg(F.count("*").alias("copies_"))
    summed = counted.withColumn("each_", F.col("n")).withColumn("n", F.col("n") * F.col("copies_"))
    copy = _numbered(ranged(summed, key, buckets), key).withColumn("n_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies_") - 1)))
    offset = F.col("offset") + F.col("n_") * F.coalesce("each_", F.lit(0))
    return copy.withColumn("offset", offset).select(*[F.col("each_").alias("n") if c == "n" else F.col(f"`{c}`") for c in sizes.columns], "offset")


def range_of(value: Column, bounds: list) -> Column:
    """How many bounds are at or below a value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def next_byte_counts(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token, target (two hex digits), n: how often a byte follows another in the stream of the texts in key order.

    Each task adds up the pairs inside its texts; pairs over a border come from first and last bytes, by offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << 16, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                own = np.frombuffer((text.as_py() or "").encode(), np.uint8).astype(np.uint16)
                held.append(own[:-1] << 8 | own[1:])
                size += len(own)
                if size > 1 << 20:  # many texts at once
                    total += np.bincount(np.concatenate(held), minlength=1 << 16)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << 16)
        at = np.flatnonzero(total)
        names = [f"{i:02x}" for i in range(256)]
        yield pa.RecordBatch.from_pydict({"token": pa.array([names[i >> 8] for i in at], pa.string()), "target": pa.array([names[i & 255] for i in at], pa.string()), "n": total[at]})

    own = docs.select(text_col).mapInArrow(run, "token string, target string, n long")
    raw = F.encode(F.col(text_col), "UTF-8")
    ends = docs.where(F.octet_length(text_col) > 0).select(key, *[F.lower(F.hex(F.substring(raw, at, 1))).alias(x) for x, at in (("first", 1), ("token", -1))], F.lit(1).cast("long").alias("n"))
    placed = offsets(ends, key)
    border = placed.select("offset", "token").join(placed.select((F.col("offset") - 1).alias("offset"), F.col("first").alias("target")), "offset")
    return own.unionAll(border.select("token", "target", F.lit(1).cast("long").alias("n"))).groupBy("token", "target").agg(F.sum("n").alias("n"))


def split_tail(n: Column, most: int = 1_000_000) -> Column:
    """Where validation begins in a stream of n tokens: its last tenth, `most` tokens at most."""
    return n - F.least(F.lit(most).cast("long"), F.floor(n / 10).cast("long"))


def split_share(n: Column, share: float = 0.9) -> Column:
    """Where validation begins: the floor of a share of n."""
    return F.floor(F.lit(share) * n).cast("long")


def split_sizes(offset: DataFrame, border: Column | int) -> DataFrame:
    """key columns, train and val tokens of each document: those before and from the border on."""
    border = F.lit(border) if isinstance(border, int) else border
    train = F.least(F.col("n"), F.greatest(F.lit(0).cast("long"), border - F.col("offset")))
    return offset.withColumn("train", train).withColumn("val", F.col("n") - train)


def _touched(placed: DataFrame, block: int) -> DataFrame:
    """`placed` (n, offset) with a row for each chunk that a document touches: chunk_id, begin_ and size_ of its part in the document."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("offset") - block) / F.lit(block)).cast("long"))
    last = F.floor((F.col("offset") + F.col("n") - 1) / F.lit(block)).cast("long")
    cut = placed.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0).cast("long"), F.col("chunk_id") * block - F.col("offset"))
    end = F.least(F.col("n"), F.col("chunk_id") * block + block + 1 - F.col("offset"))
    return cut.withColumn("begin_", begin.cast("int")).withColumn("size_", (end - begin).cast("int")).where("size_ > 0")


def _sewn(tokens: DataFrame, block: int, key: str, part: Column, joined: Callable[[Column], Column], whole: Column) -> DataFrame:
    """chunk_id, w: the whole chunks of `tokens` (key, n, ids).

    Documents are dealt to ranges of the key once; a range cuts its documents and puts together the chunks that lie in it, all
    behind that one shuffle. Only what is left at the ragged ends of ranges meets in a second one, by chunk.
    """
    reserve(tokens, "range_", "order_", "start_", "within_", "offset", "n_", "chunk_id", "begin_", "size_")
    placed = ranged(tokens.where("n > 0"), key, 4 * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = _touched(_numbered(placed, key), block).select("range_", "chunk_id", F.struct("offset", part.alias("ids")).alias("part"))
    put = lambda rows, by, at: rows.groupBy(*by).agg(F.array_sort(F.collect_list(at)).alias("all_")).select(*by, F.col("all_")[0]["offset"].alias("offset"), joined(F.transform("all_", lambda p: p["ids"])).alias("w"))
    pieces = put(parts, ["range_", "chunk_id"], "part")
    ends = put(pieces.where(~whole), ["chunk_id"], F.struct("offset", F.col("w").alias("ids")))
    return pieces.where(whole).select("chunk_id", "w").unionAll(ends.where(whole).select("chunk_id", "w"))


def chunks(tokens: DataFrame, block: int, key: str = "doc_id") -> DataFrame:
    """chunk_id, x, y of the stream of `tokens` (key, ids): non-overlapping inputs of `block` ids and the same shifted by one.

    Rows go by key (null first), rows of one key by a hash of the row. Null ids count as none; further columns are left behind. The
    incomplete last chunk is left out.
    """
    sized = tokens.select(key, F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n"), "ids")
    own = F.slice("ids", F.col("begin_") + 1, F.col("size_"))
    cut = _sewn(sized, block, key, own, F.flatten, F.size("w") == block + 1)
    return cut.select("chunk_id", F.slice("w", 1, block).alias("x"), F.slice("w", 2, block).alias("y"))


def packed_bytes(docs: DataFrame, end_id: int, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n, ids: UTF-8 bytes and an end id as big-endian 16-bit integers in one binary; n comes without spelling the ids.

    Null text is the empty text: its end id is in the stream.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spelled = F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "00$1")
    ids = F.unhex(F.concat(spelled, F.lit(f"{end_id:04X}")))
    return docs.select(key, (F.octet_length(text) + 1).cast("long").alias("n"), ids.alias("ids"))


def packed_chunks(tokens: DataFrame, block: int, width: int = 2, key: str = "doc_id") -> DataFrame:
    """chunk_id, x, y as of chunks(), for `tokens` (key, n, ids) whose ids are packed, `width` bytes each: binaries all the way."""
    own = F.substring("ids", F.col("begin_") * width + 1, F.col("size_") * width)
    joined = lambda parts: F.aggregate(parts, F.lit(b""), lambda w, p: F.concat(w, p))
    cut = _sewn(tokens.select(key, "n", "ids"), block, key, own, joined, F.octet_length("w") == (block + 1) * width)
    return cut.select("chunk_id", F.substring("w", 1, block * width).alias("x"), F.substring("w", width + 1, block * width).alias("y"))


def shuffled_batches(samples: DataFrame, size: int, seed: int = 42, key: str = "chunk_id") -> DataFrame:
    """`samples` (key) with place and batch_id in a permutation that the seed fixes; the last batch may be short."""
    reserve(samples, "order_", "range_", "start_", "place", "batch_id")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    prefix = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    ranged = samples.withColumn("order_", order).withColumn("range_", prefix)
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    starts = ranged.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    place = F.col("start_") + F.row_number().over(Window.partitionBy("range_").orderBy("order_", key)) - 1
    placed = ranged.join(starts, "range_").withColumn("place", place.cast("long"))
    return placed.withColumn("batch_id", F.floor(F.col("place") / size).cast("long")).drop("order_", "range_", "start_")


#: Rounds of the permutation, and how often a number that falls outside is permuted again. Less than a row's width of numbers lies
#: outside, so below WALK squared numbers this always suffices, and beyond it fails for no number in practice; it raises if it does.
ROUNDS, WALK = 6, 64


def _sides(n: int) -> tuple[int, int]:
    """Rows and columns of the smallest near-square that holds n numbers."""
    rows = max(1, math.isqrt(max(0, n - 1)) + (n > 1))
    return rows, max(1, -(-n // rows))


def _feistel(number: Column, n: int, seed: int, back: bool) -> Column:
    """One pass of the network over rows * columns numbers: each round shifts one half by a hash of the other; backwards it undoes it."""
    rows, columns = _sides(n)
    drawn = lambda k, half: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"), half.cast("string"))), 1, 8), 16, 10).cast("long")
    sign = -1 if back else 1
    step = lambda s, k: F.when(k % 2 == 0, F.struct(F.pmod(s["l"] + sign * drawn(k, s["r"]), F.lit(rows)).alias("l"), s["r"].alias("r"))).otherwise(
        F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * drawn(k, s["l"]), F.lit(columns)).alias("r"))
    )
    start = F.struct(F.floor(number / F.lit(columns)).cast("long").alias("l"), F.pmod(number, F.lit(columns)).cast("long").alias("r"))
    order = list(range(ROUNDS))[::-1] if back else list(range(ROUNDS))
    return F.aggregate(F.array(*map(F.lit, order)), start, step, lambda s: (s["l"] * columns + s["r"]).cast("long"))


def _walked(number: Column, n: int, seed: int, back: bool) -> Column:
    """Permuted until it falls among the n numbers again (cycle walking), which keeps it a bijection of them."""
    again = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, lambda y, _: F.when(y < n, y).otherwise(_feistel(y, n, seed, back)), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("the walk didn't come back"))))
    return F.get(F.transform(F.array(_feistel(number, n, seed, back)), lambda y: F.when(y < n, y).otherwise(again(y))), F.lit(0)).cast("long")


def permuted(number: Column, n: int, seed: int = 42) -> Column:
    """The place of a number (0 to n - 1) in the permutation of n numbers that the seed fixes: a Feistel network, no sort."""
    return _walked(number.cast("long"), n, seed, False)


def permuted_back(place: Column, n: int, seed: int = 42) -> Column:
    """The number at a place of permuted()."""
    return _walked(place.cast("long"), n, seed, True)


def permuted_batches(samples: DataFrame, size: int, seed: int = 42, key: str = "chunk_id") -> DataFrame:
    """`samples` with number (its row number in key order), place and batch_id in the seed's permutation; the last batch may be short.

    The row numbers are offsets() of ones; a place is computed from the number alone.
    """
    reserve(samples, "n", "number", "place", "batch_id")
    n = samples.count()
    numbered = offsets(samples.withColumn("n", F.lit(1).cast("long")), key).drop("n").withColumnRenamed("offset", "number")
    placed = numbered.withColumn("place", permuted(F.col("number"), n, seed))
    return placed.withColumn("batch_id", F.floor(F.col("place") / size).cast("long"))


def crop(ids: Column, most: int) -> Column:
    """The last `most` ids."""
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - most + 1), F.lit(most))
