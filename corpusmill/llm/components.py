"""Connected components of a distributed edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v.

    large: every neighbour above a node is linked to the least of the node and its neighbours. small: a node and its neighbours
    below it are linked to the least of them. The least neighbour is a partial aggregate; the join back is over pairs of longs.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node of `edges` (a, b: long; any order, repeats and loops allowed).

    Every round writes its edges to the shared folder; it ends when a round changes nothing (a logarithmic number of rounds).
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    said = _sum(now)
    for _ in range(most_rounds):
        old, now = now, materialize(_star(_star(now, True), False), "edges")
        discard(old)
        before, said = said, _sum(now)
        if said == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
