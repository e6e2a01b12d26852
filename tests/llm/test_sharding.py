import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import sharding


def brute_capacity(sizes, shards):
    n = len(sizes)
    best = None
    for cut in itertools.combinations_with_replacement(range(n + 1), shards - 1):
        ends = [0, *cut, n]
        most = max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:]))
        best = most if best is None else min(best, most)
    return best


def test_capacity_is_minimal_and_kept():
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.choice([0, 1, 2, 5, 9, 40]) for _ in range(r.randrange(0, 9))]
        shards = r.randrange(1, 5)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == brute_capacity(sizes, shards)
        begins = [0, *sharding.cuts(sizes, shards), len(sizes)]
        assert len(begins) == shards + 1 and begins == sorted(begins)
        assert all(sum(sizes[a:b]) <= capacity for a, b in zip(begins, begins[1:]))


def test_a_large_group_does_not_starve_the_others():
    sizes = [10] * 300 + [5000] + [10] * 300
    begins = [0, *sharding.cuts(sizes, 40), len(sizes)]
    sums = sorted(sum(sizes[a:b]) for a, b in zip(begins, begins[1:]))
    assert sums[-1] == 5000 and sums[0] > 0 and sums[-2] <= 2 * 6000 / 39


def rows_of(spark, rows, shards=7):
    return sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, size int, shard string"), shards).collect()


def test_documents(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "same", f"text {i} é" * r.randrange(1, 30)]), i, "x") for i in range(400)]
    rows += [(3, "same", 0, "x"), (None, "lost", 0, None), (None, "lost", 0, None)]
    got = rows_of(spark, rows)
    assert sorted(zip((str(g.doc_id) for g in got), (g["size"] for g in got), (g.text_crc32 for g in got))) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {g.law for g in got} == {"bytes"} and {g.grown_shard for g in got} == {None}
    by_text = {}
    for g in got:
        by_text.setdefault(g.text_crc32, set()).add(g.shard)
    assert all(len(s) == 1 for s in by_text.values())
    slots = {}
    for g in got:
        slots.setdefault(g.shard, []).append(g.slot)
    assert set(slots) <= set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for g in got:
        groups[g.text_crc32] = groups.get(g.text_crc32, 0) + g["size"]
    sums = {}
    for g in got:
        sums[g.shard] = sums.get(g.shard, 0) + g["size"]
    assert max(sums.values()) <= sum(sums.values()) / 7 + max(groups.values())


def sizes_of(groups):
    by = {}
    for digest, size in groups:
        by[digest] = by.get(digest, 0) + size
    return [by[d] for d in sorted(by)]


@pytest.mark.parametrize("seed,digits,groups,shards", [(0, 1, 1500, 13), (1, 1, 400, 40), (2, 2, 3000, 5), (3, 1, 30, 40)])
def test_ranges_find_the_capacity_over_groups(spark, seed, digits, groups, shards, monkeypatch):
    monkeypatch.setattr(sharding, "HEX", digits)
    r = random.Random(seed)
    rows = [(hashlib.md5(str(r.randrange(groups)).encode()).hexdigest(), r.choice([16, 20, 50, 4000, r.randrange(16, 90_000)])) for _ in range(groups * 2)]
    found = sharding.ranges_of(spark.createDataFrame(rows, "digest string, size long"), shards)
    assert sharding.smallest_capacity([size for _, size, _ in found.rows], shards) == sharding.smallest_capacity(sizes_of(rows), shards)
    assert [p for p, _, _ in found.rows] == sorted(p for p, _, _ in found.rows) and found.ends[-1] == sum(s for _, s in rows)


def test_more_groups_than_prefixes(spark):
    docs = spark.range(90_000).selectExpr("id doc_id", "repeat(CAST(id AS STRING), 1 + CAST(pmod(hash(id), 60) AS INT)) text")
    sums = sorted(r.s for r in sharding.shard_documents(docs, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect())
    groups = [(hashlib.md5(r.text.encode()).hexdigest(), len(r.text) + 16) for r in docs.collect()]
    assert sums[-1] <= sharding.smallest_capacity(sizes_of(groups), 40)


@pytest.mark.parametrize("rows", [[], [(1, "a", 0, "")], [(i, "hot", 0, "") for i in range(50)]])
def test_small_tables(spark, rows):
    got = rows_of(spark, rows, 40)
    assert sorted(g.slot for g in got) == list(range(len(rows)))


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = sharding.shard_documents(docs, 3)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
