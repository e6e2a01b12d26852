"""Attention and linear layers at real widths: blocks of vectors meet, and partial results are merged.

No row is made for a pair of positions or for a single weight; what is shuffled grows with the positions, the weights and the
outputs. Numpy works on one pair of blocks at a time inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import let
from .names import reserve

#: Queries of one sequence are dealt over so many tasks; keys go to each of them.
LANES = 8


def _matrix(rows: pa.ListScalar) -> np.ndarray:
    """array<array<double>> as a matrix."""
    inner = rows.values
    return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1)


def _partial(batches: Iterator[pa.RecordBatch], causal: bool) -> Iterator[pa.RecordBatch]:
    """For pairs of blocks (seq, head, qt, qx, kt, kx): for each query t the highest score m, the sum s of exp(score - m), and the
    vectors weighted so, v; blocks of keys of the same queries that come together in a batch are merged on the way."""
    for batch in batches:
        held: dict[tuple, list] = {}
        seq, head, qt, qx, kt, kx = batch.columns
        for i in range(batch.num_rows):
            query, key = _matrix(qx[i]), _matrix(kx[i])
            at, of = qt[i].values.to_numpy(), kt[i].values.to_numpy()
            score = query @ key.T / np.sqrt(query.shape[1])
            if causal:
                score[of[None, :] > at[:, None]] = -np.inf
            top = score.max(axis=1)
            raised = np.exp(score - np.where(np.isfinite(top), top, 0.0)[:, None])
            new = [top, raised.sum(axis=1), raised @ key, i]
            name = (seq[i].as_py(), head[i].as_py(), int(at[0]))
            held[name] = _merged(held[name], new) if name in held else new
        out: dict[str, list] = {k: [] for k in ("row", "t", "m", "s", "v")}
        for top, total, vector, i in held.values():
            known = np.isfinite(top)
            out["row"] += [i] * int(known.sum())
            out["t"].append(qt[i].values.to_numpy()[known])
            out["m"].append(top[known])
            out["s"].append(total[known])
            out["v"] += list(vector[known])
        if out["row"]:
            row = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([seq.take(row), head.take(row), *(pa.array(np.concatenate(out[k])) for k in "tms"), pa.array(out["v"], pa.list_(pa.float64()))], ["seq", "head", "t", "m", "s", "v"])


def _merged(a: list, b: list) -> list:
    """Two partial results of the same queries as one: sums and vectors are brought to the higher of the two scores."""
    top = np.maximum(a[0], b[0])
    base = np.where(np.isfinite(top), top, 0.0)
    one, other = np.exp(a[0] - base), np.exp(b[0] - base)
    return [top, a[1] * one + b[1] * other, a[2] * one[:, None] + b[2] * other[:, None], a[3]]


def blockwise_attention(x: DataFrame, block: int = 128, value: str = "x", causal: bool = True, lanes: int = LANES) -> DataFrame:
    """seq, head, t, o (array<double>): attention of `x` (seq, head, t, value) over itself by an online softmax.

    Vectors of one seq and head have one length; t is unique there. Rows with a null seq or head meet nothing and are left out.
    """
    seq, head = x.schema["seq"].dataType.simpleString(), x.schema["head"].dataType.simpleString()
    vector = F.transform(value, lambda v: v.cast("double"))
    rows = x.select("seq", "head", F.col("t").cast("long").alias("t"), vector.alias("v"))
    blocks = rows.groupBy("seq", "head", F.floor(F.col("t") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))
    queries = blocks.select("seq", "head", F.pmod("b", F.lit(lanes)).cast("int").alias("lane"), F.col("b").alias("qb"), F.col("r.t").alias("qt"), F.col("r.v").alias("qx"))
    keys = blocks.select("seq", "head", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("b").alias("kb"), F.col("r.t").alias("kt"), F.col("r.v").alias("kx"))
    pairs = queries.join(keys, ["seq", "head", "lane"])
    pairs = pairs.where("kb <= qb") if causal else pairs
    partial = pairs.select("seq", "head", "qt", "qx", "kt", "kx").mapInArrow(lambda b: _partial(b, causal), f"seq {seq}, head {head}, t long, m double, s double, v array<double>")
    merged = partial.groupBy("seq", "head", "t").agg(F.collect_list(F.struct("m", "s", "v")).alias("p"))
    return merged.select("seq", "head", "t", _finished(F.col("p")).alias("o"))


def _finished(parts: Column) -> Column:
    """The weighted vectors of all partial results, divided by their sum."""

    def with_top(parts: Column, top: Column) -> Column:
        weighted = F.transform(parts, lambda p: let(F.exp(p["m"] - top), lambda e: F.struct((p["s"] * e).alias("s"), F.transform(p["v"], lambda v: v * e).alias("v"))))
        add = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), F.zip_with(a["v"], b["v"], lambda x, y: x + y).alias("v"))
        total = lambda w: F.aggregate(F.slice(w, F.lit(2), F.size(w)), F.get(w, F.lit(0)), add, lambda a: F.transform(a["v"], lambda v: v / a["s"]))
        return let(weighted, total)

    return let(parts, lambda p: let(F.array_max(F.transform(p, lambda q: q["m"])), lambda top: with_top(p, top)))


def tiles(weights: DataFrame, tile: int = 128) -> DataFrame:
    """ib, ob, w (array of `tile` * `tile` doubles, one row for each output): `weights` (o, i, w) in tiles; weights that aren't there are 0."""
    at = (F.col("o") % tile * tile + F.col("i") % tile).cast("int")
    cells = weights.select(F.floor(F.col("i") / tile).alias("ib"), F.floor(F.col("o") / tile).alias("ob"), at.alias("at"), F.col("w").cast("double").alias("w"))
    listed = cells.groupBy("ib", "ob").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("c"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = []
            for c in batch.column(2):
                own = np.zeros(tile * tile)
                own[c.values.field("at").to_numpy()] = c.values.field("w").to_numpy()
                full.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(full, pa.list_(pa.float64()))], ["ib", "ob", "w"])

    return listed.mapInArrow(dense, "ib long, ob long, w array<double>")


def tiled_linear(x: DataFrame, weights: DataFrame, outputs: int, bias: DataFrame | None = None, key: str = "key", value: str = "x", tile: int = 128, group: int = 256) -> DataFrame:
    """key, y (array of `outputs` doubles): weights times x plus the bias, for `x` (key, value) and tables `weights` (o, i, w) and
    `bias` (o, b).

    Vectors are cut into slices of `tile`; a slice meets the tiles of its inputs, `group` vectors at once, and the partial
    products are added up by output tile. The plan is the same for any width. Keys are unique and not null.
    """
    reserve(x.select(key), "ib", "ob", "lane", "part", "y")
    kind = x.schema[key].dataType.simpleString()
    vector = F.transform(value, lambda v: v.cast("double"))
    cut = x.select(F.col(key).alias("key"), vector.alias("v")).select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("v") / F.lit(tile)).cast("int") - 1), lambda k: F.slice("v", k * tile + 1, F.lit(tile)))).alias("ib", "part"))
    lanes = max(1, -(-x.count() // group))
    grouped = cut.groupBy("ib", F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane")).agg(F.collect_list(F.struct("key", "part")).alias("rows")).withColumn("ib", F.col("ib").cast("long"))
    met = grouped.join(tiles(weights, tile), "ib").select(F.col("rows.key").alias("keys"), F.col("rows.part").alias("parts"), "ob", "w")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, parts, ob, w in zip(*batch.columns):
                own = np.zeros((len(parts), tile))
                for i, p in enumerate(parts.values):
                    own[i, : len(p)] = p.values.to_numpy()
                made = own @ w.values.to_numpy().reshape(tile, tile).T
                yield pa.RecordBatch.from_arrays([keys.values, pa.array([ob.as_py()] * len(made), pa.int64()), pa.array(list(made), pa.list_(pa.float64()))], ["key", "ob", "y"])

    partial = met.mapInArrow(multiply, f"key {kind}, ob long, y array<double>")
    added = partial.groupBy("key", "ob").agg(F.collect_list("y").alias("ys"))
    summed = added.select("key", "ob", let(F.col("ys"), lambda ys: F.aggregate(F.slice(ys, F.lit(2), F.size(ys)), F.get(ys, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))).alias("y"))
    whole = summed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ob", "y"))).alias("all")).select("key", F.slice(F.flatten("all.y"), 1, outputs).alias("y"))
    if bias is not None:
        row = bias.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda p: p["b"].cast("double")).alias("b"))
        whole = whole.crossJoin(F.broadcast(row)).select("key", F.zip_with("y", "b", lambda y, b: y + b).alias("y"))  # one row
    return whole.withColumnRenamed("key", key)

