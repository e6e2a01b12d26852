import hashlib

import pytest

from corpusmill.operators import stream


def tokens(spark, lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>")


@pytest.mark.parametrize("lists", [[], [[]], [[1]], [[1, 2, 3, 4]], [[1, 2, 3, 4, 5]], [[1] * 8], [list(range(19))], [[1, 2], [], [3], list(range(30)), [7]]])
def test_chunks_equal_a_flat_list(spark, lists):
    flat = [t for x in lists for t in x]
    want = {i: (flat[i * 4 : i * 4 + 4], flat[i * 4 + 1 : i * 4 + 5]) for i in range(max(0, (len(flat) - 1) // 4))}
    got = {r.chunk_id: (r.x, r.y) for r in stream.chunks(tokens(spark, lists), 4).collect()}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 9, 10, 19, 20, 123])
def test_splits(spark, n):
    from pyspark.sql import functions as F

    row = spark.range(1).select(stream.split_tail(F.lit(n).cast("long"), 5).alias("a"), stream.split_share(F.lit(n).cast("long")).alias("b")).first()
    assert (row.a, row.b) == (n - min(5, n // 10), int(0.9 * n))


def test_split_sizes_add_up(spark):
    sizes = spark.createDataFrame([(i, i % 5) for i in range(100)], "doc_id long, n long")
    rows = stream.split_sizes(stream.offsets(sizes), 77).orderBy("doc_id").collect()
    assert sum(r.train for r in rows) == 77 and all(r.train + r.val == r.n for r in rows)
    assert [r.offset for r in rows] == [sum(k % 5 for k in range(i)) for i in range(100)]


def test_batches(spark):
    rows = stream.shuffled_batches(spark.range(70).withColumnRenamed("id", "chunk_id"), 32, seed=7).orderBy("place").collect()
    want = sorted(range(70), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    assert [r.chunk_id for r in rows] == want
    assert [r.batch_id for r in rows] == [i // 32 for i in range(70)]


def test_join_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in stream.join_documents(docs, "|").orderBy("doc_id").collect()] == ["a|", "|", "|"]


def packed(spark, lists):
    rows = [(i, len(x), bytearray(b"".join(v.to_bytes(2, "big") for v in x))) for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, "doc_id long, n long, ids binary")


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 8, 9, 19])
@pytest.mark.parametrize("cut", [1, 2, 7, 100])
def test_packed_chunks_and_both_splits_of_n_tokens(spark, n, cut):
    """n = 0, 1, a block, one more, 19 tokens in documents of different lengths."""
    flat = list(range(250, 250 + n))
    lists = [flat[i : i + cut] for i in range(0, n, cut)] + [[]]
    want = {i: (flat[i * 4 : i * 4 + 4], flat[i * 4 + 1 : i * 4 + 5]) for i in range(max(0, (n - 1) // 4))}
    unpack = lambda b: [int.from_bytes(b[i : i + 2], "big") for i in range(0, len(b), 2)]
    got = {r.chunk_id: (unpack(r.x), unpack(r.y)) for r in stream.packed_chunks(packed(spark, lists), 4).collect()}
    assert got == want
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(lists)], "doc_id long, n long")
    for border in (n - min(5, n // 10), int(0.9 * n)):
        rows = stream.split_sizes(stream.offsets(sizes), border).collect()
        assert sum(r.train for r in rows) == border and sum(r.val for r in rows) == n - border


def test_packed_bytes(spark):
    docs = spark.createDataFrame([(1, "aé"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.n, None if r.ids is None else bytes(r.ids).hex()) for r in stream.packed_bytes(docs, 256).collect()}
    assert rows == {1: (4, "006100c300a90100"), 2: (1, "0100"), 3: (1, "0100")}


@pytest.mark.parametrize("f,name", [(lambda d: stream.offsets(d), "range_"), (lambda d: stream.offsets(d), "OFFSET"), (lambda d: stream.shuffled_batches(d, 2, key="doc_id"), "place")])
def test_clashing_names_raise(spark, f, name):
    with pytest.raises(ValueError, match="adds itself"):
        f(spark.createDataFrame([(1, 2, 3)], f"doc_id long, n long, {name} int"))


def test_a_null_text_keeps_its_end_in_the_stream(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "defgh"), (4, "ijk")], "doc_id long, text string")
    flat = [*b"abc", 256, 256, *b"defgh", 256, *b"ijk", 256]
    want = {i: flat[4 * i : 4 * i + 4] for i in range((len(flat) - 1) // 4)}
    got = {r.chunk_id: r.x for r in stream.chunks(stream.byte_tokens(docs, 256), 4).collect()}
    cut = {r.chunk_id: [int.from_bytes(r.x[i : i + 2], "big") for i in range(0, 8, 2)] for r in stream.packed_chunks(stream.packed_bytes(docs, 256), 4).collect()}
    assert got == cut == want


def test_offsets_of_nulls_ties_and_a_key_of_most_rows(spark):
    import random
    from collections import defaultdict

    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(7, r.randrange(5)) for _ in range(3000)] + [(None, r.randrange(5)) for _ in range(800)] + [(r.randrange(-50, 50), r.randrange(5)) for _ in range(500)]
    sizes = spark.createDataFrame(rows, "doc_id long, n long").repartition(5)
    placed = stream.offsets(sizes, buckets=16).collect()
    at = 0
    for row in sorted(placed, key=lambda x: (x.offset, x.n)):
        assert row.offset == at
        at += row.n
    bounds = defaultdict(list)
    for row in placed:
        bounds[row.doc_id].append((row.offset, row.offset + row.n))
    ordered = sorted(bounds, key=lambda k: (k is not None, k or 0))
    for a, b in zip(ordered, ordered[1:]):
        assert max(e for _, e in bounds[a]) <= min(s for s, _ in bounds[b])
    unlike = sizes.withColumn("other", F.monotonically_increasing_id())
    spread = stream.ranged(unlike, "doc_id", 16).groupBy("range_").count().collect()
    assert max(x["count"] for x in spread) < 600 and len(spread) > 10


def test_a_million_rows_of_one_key_over_several_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1_000_000).select(F.lit(5).cast("long").alias("doc_id"), (F.col("id") % 10).alias("n"))
    rows = rows.withColumn("other", F.xxhash64("n", F.monotonically_increasing_id()))
    spread = [x["count"] for x in stream.ranged(rows, "doc_id", 8).groupBy("range_").count().collect()]
    assert len(spread) >= 7 and max(spread) < 200_000
    for same in (rows, rows.drop("other")):
        placed = stream.offsets(same, buckets=8)
        assert placed.count() == 1_000_000
        assert placed.agg(F.max(F.col("offset") + F.col("n"))).first()[0] == 4_500_000
        assert placed.where("n > 0").select("offset").distinct().count() == 900_000


@pytest.mark.parametrize("block", [1, 3, 50])
def test_chunks_of_repeated_and_null_keys_over_many_ranges(spark, block):
    """Chunks that span many ranges and ranges that hold many chunks; the stream is that of the rows in their order."""
    from pyspark.sql import functions as F

    rows = [(k, [1000 * i + j for j in range(i % 7)]) for i, k in enumerate([None, None, 3, 3, 3, 3, 3, *range(40), 3, 3])]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(4)
    sized = tokens.select("doc_id", F.size("ids").cast("long").alias("n"), "ids").where("n > 0")
    flat = [t for r in sorted(stream.ranged(sized, "doc_id").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.order_)) for t in r.ids]
    want = {i: (flat[i * block : i * block + block], flat[i * block + 1 : i * block + block + 1]) for i in range((len(flat) - 1) // block)}
    assert {r.chunk_id: (r.x, r.y) for r in stream.chunks(tokens, block).collect()} == want


def test_chunks_shuffle_ids_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cut = stream.packed_chunks(stream.packed_bytes(docs, 256), 64)
    cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffled = [x for x in plan.split("\n") if " Exchange " in f" {x.strip()} " or "- Exchange" in x]
    by_range = [x for x in shuffled if "hashpartitioning(range_" in x and "Reused" not in x]
    assert "ReusedExchange" in plan
    assert len([x for x in shuffled if "hashpartitioning(chunk_id" in x]) == 1
    assert len(by_range) <= 2, by_range  # the documents, and the sums of ranges


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_permutation_is_a_bijection_with_an_inverse(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(n).select("id", stream.permuted(F.col("id"), n, 9).alias("place"))
    rows = rows.withColumn("back", stream.permuted_back(F.col("place"), n, 9)).collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert n < 16 or sum(r.place == r.id for r in rows) < n / 4


def test_permuted_batches_sort_by_no_hash(spark):
    samples = spark.createDataFrame([(k,) for k in [None, 3, 3, *range(60)]], "chunk_id long").repartition(3)
    made = stream.permuted_batches(samples, 8)
    rows = made.collect()
    assert sorted(r.place for r in rows) == list(range(63)) and all(r.batch_id == r.place // 8 for r in rows)
    assert [r.chunk_id for r in sorted(rows, key=lambda r: r.number)] == [None, 0, 1, 2, 3, 3, 3, *range(4, 60)]
    assert "md5" not in "".join(x for x in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort" in x or "Window" in x)
