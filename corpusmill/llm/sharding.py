"""Sharding by a minimax contiguous partition, with DataFrame functions only.

Rows with equal texts are an atomic group. Groups are ordered by the MD5 of their text. Over that list the smallest feasible
shard capacity is found by binary search, each guess checked greedily; then the list is cut so that no shard exceeds that
capacity and, within it, shards are as even as their order allows.

The list has a size for each distinct text, so it isn't collected. It is read by ranges: first a range for each of the 16^HEX
prefixes of the MD5. A partition that cuts between ranges gives an upper bound of the capacity; one that may cut a range
anywhere, unless one group fills it, gives a lower bound. While the two differ, the ranges in which a cut can lie between
these bounds are read by longer prefixes. What is found is the smallest capacity over the groups themselves.

Defined results: size is the text's UTF-8 bytes (null: 0) plus 16; null and empty texts are one group with crc32 0; null and
repeated doc_id are kept, one row for each input row; with fewer groups than shards some shards are empty; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_columns

HEX = 4
RANGES = 1 << 18  # ranges that are read at once, about
ROWS_A_CHUNK = 100_000


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which the ordered sizes fit into `shards` contiguous shards."""
    ends = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-ends[-1] // shards)]), ends[-1]
    while low < high:
        guess, at = (low + high) // 2, 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + guess) - 1
        low, high = (low, guess) if at == len(sizes) else (guess + 1, high)
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Where each shard after the first begins in the ordered sizes (shards - 1 places); none exceeds smallest_capacity()."""
    n, capacity = len(sizes), smallest_capacity(sizes, shards)
    ends = [0, *accumulate(sizes)]
    latest = [n]  # latest[k]: from here on, k shards of the capacity suffice
    for _ in range(shards):
        latest.append(bisect_left(ends, ends[latest[-1]] - capacity))
    fair, large = ends[-1] / shards, 0
    while True:  # sizes above an even share stand alone and don't count for the others' share
        over = [s for s in sizes if s > fair]
        if len(over) == large or len(over) >= shards:
            break
        large, fair = len(over), (ends[-1] - sum(over)) / (shards - len(over))
    small_ends = [0, *accumulate(0 if s > fair else s for s in sizes)]
    large_ends = [0, *accumulate(1 if s > fair else 0 for s in sizes)]
    at, found = 0, []
    for k in range(shards - 1):
        left = shards - k
        farthest = bisect_right(ends, ends[at] + capacity) - 1
        nearest = max(at, min(latest[left - 1], farthest))
        rest = max(1, left - (large_ends[n] - large_ends[at]))
        share = (small_ends[n] - small_ends[at]) / rest
        goal = bisect_left(ends, ends[at] + share)
        if goal > at and goal <= n and ends[goal] - ends[at] - share > share - (ends[goal - 1] - ends[at]):
            goal -= 1
        goal = max(goal, at + 1) if at < n and sizes[at] > fair else goal
        at = max(nearest, min(goal, farthest))
        found.append(at)
    return found


class Ranges:
    """The ordered groups by ranges: prefix of each, its size, and whether one group fills it."""

    def __init__(self, rows: list[tuple[str, int, bool]], shards: int):
        self.rows, self.shards = sorted(rows), shards
        self.ends = [0, *accumulate(size for _, size, _ in self.rows)]

    def steps(self, capacity: int, anywhere: bool) -> list[int]:
        """Where the shards' ends lie, filled one after another up to the capacity: between ranges, or `anywhere` but in a group."""
        at, found = 0, []
        for _ in range(self.shards):
            i = bisect_right(self.ends, at + capacity) - 1
            inside = anywhere and i < len(self.rows) and not self.rows[i][2]
            at = at + capacity if inside else max(at, self.ends[i])
            found.append(min(at, self.ends[-1]))
        return found

    def smallest(self, anywhere: bool) -> int:
        low, high = -(-self.ends[-1] // self.shards), self.ends[-1]
        while low < high:
            guess = (low + high) // 2
            low, high = (low, guess) if self.steps(guess, anywhere)[-1] == self.ends[-1] else (guess + 1, high)
        return low

    def unclear(self) -> list[str]:
        """Prefixes of the ranges to be read more closely; none if the capacity is known."""
        low, high = self.smallest(True), self.smallest(False)
        wanted: set[str] = set()
        if low < high:
            for first, last in zip(self.steps(low, False), self.steps(high, True)):
                wanted.update(p for p, _, single in self.rows[max(0, bisect_left(self.ends, first) - 1) : bisect_right(self.ends, last)] if not single)
        return sorted(wanted)

    def replaced(self, prefixes: list[str], rows: list[tuple[str, int, bool]]) -> Ranges:
        gone = set(prefixes)
        return Ranges([r for r in self.rows if r[0] not in gone] + rows, self.shards)


def ranges_of(groups: DataFrame, shards: int) -> Ranges:
    """The ranges of `groups` (digest: MD5 in hex, size), read as closely as the smallest capacity needs."""

    def read(rows: DataFrame, digits) -> list[tuple[str, int, bool]]:
        by = rows.groupBy(F.substring("digest", F.lit(1), digits).alias("p")).agg(F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("single"))
        return [tuple(r) for r in by.collect()]  # about RANGES rows at most

    found = Ranges(read(groups, F.lit(HEX)), shards)
    while prefixes := found.unclear():
        more = 2 if len(prefixes) * 256 <= RANGES else 1
        parts = []
        for n in sorted({len(p) for p in prefixes}):  # of few lengths
            some = groups.where(F.substring("digest", 1, n).isin([p for p in prefixes if len(p) == n]))
            parts.append(some.withColumn("digits", F.lit(min(32, n + more))))
        found = found.replaced(prefixes, read(reduce(DataFrame.unionAll, parts), F.col("digits")))
    return found


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of `docs`."""
    own = own_columns(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        own.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("digest"),
            F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("int").alias("deal"),  # parts rows that repeat doc_id and text
        ),
        "shard-rows",
    )
    found = ranges_of(rows.select("digest", "size"), shards)
    begins = cuts([size for _, size, _ in found.rows], shards)
    shard = F.lit(0)
    for begin in begins:
        first = found.rows[begin][0] if begin < len(found.rows) else "g"  # behind all hex digits
        shard = shard + (F.col("digest") >= first).cast("int")
    # Slots: rows are numbered within chunks of a shard, and a chunk begins where those before it end.
    chunks = max(16, -(-rows.count() // ROWS_A_CHUNK))
    placed = rows.withColumn("shard", shard).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "deal"), F.lit(chunks)).cast("int")).drop("digest")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
