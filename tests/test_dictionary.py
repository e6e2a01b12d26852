"""Encoding by a dictionary join against the tokenizer's own encoding of each text."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bpe

SPECIALS = ["<|endoftext|>", "<|pad|>"]


@pytest.fixture(scope="module")
def tokenizer(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the herons waded past the mill", "it's more than enough, isn't it?", "日本語 ünïcödé 12345"] * 5)], "doc_id long, text string")
    return bpe.Tokenizer.train(docs, 300, SPECIALS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    pool = ["the", " herons", "x" * 100, "\n\n ", "<|pad|>", "<|endoftext|>", "<|", "日本", "'s", " 12", "é", "rare%d", " "]
    texts = ["".join(r.choice(pool).replace("%d", str(r.randrange(999))) for _ in range(r.randrange(30))) for _ in range(200)]
    made = [(i, t, i % 3) for i, t in enumerate(texts)] + [(None, None, 1), (None, "", 2), (None, "the", 3), (None, "the", 3)]
    return made + [(7, "one key", 4), (7, "two texts", 4), (7, "two texts", 4), (7, "two texts", 5), (8, texts[8], 2)]


@pytest.mark.parametrize("hot", [0, 3, 65_536])
@pytest.mark.parametrize("end", [None, SPECIALS[0]])
def test_equal_to_each_text_alone(spark, tokenizer, rows, hot, end):
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(3)
    got = bpe.encode_documents(docs, tokenizer, end=end, hot_words=hot)
    assert got.columns == ["doc_id", "other", "ids"]
    tail = [0] if end else []
    key = lambda x: str(x)
    assert sorted((key((r.doc_id, r.other, r.ids)) for r in got.collect())) == sorted(key((d, o, tokenizer.encode(t or "") + tail)) for d, t, o in rows)


def test_empty_table(spark, tokenizer):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, tokenizer).collect() == []


def test_each_word_is_encoded_once(spark, tokenizer):
    docs = spark.createDataFrame([(1, "the the<|pad|>the"), (2, "the <|pad|>"), (3, None)], "doc_id long, text string")
    table = {r.word: (r.n, r.code) for r in bpe.dictionary(docs, tokenizer).collect()}
    assert {w: n for w, (n, _) in table.items()} == {"the": 3, " the": 1, "<|pad|>": 2, " ": 1}
    assert all(code == tokenizer.encode(w) for w, (_, code) in table.items())


def test_plan_broadcasts_a_bounded_table_and_shuffles_occurrences_once(spark):
    tokenizer = bpe.Tokenizer.from_merges([(b"t", b"h")], SPECIALS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = bpe.encode_documents(docs, tokenizer, end=SPECIALS[0])
    made.write.format("noop").mode("overwrite").save()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    assert plan.count("strategy=broadcast") <= 2  # the hot words, in the two uses of one stage
    assert plan.count(f"GlobalLimit {bpe.HOT_WORDS}") >= 1
    physical = made._jdf.queryExecution().executedPlan().toString()
    made.collect()
    physical = made._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in physical


def test_other_columns_may_have_odd_names(spark, tokenizer):
    docs = spark.createDataFrame([(1, "the", 2)], "doc_id long, text string, `a.b` int")
    assert bpe.encode_documents(docs, tokenizer).select(F.col("`a.b`"), "ids").first() == (2, tokenizer.encode("the"))


def test_occurrences_of_frequent_words_are_not_shuffled(spark, tokenizer):
    """What is dealt out by document are texts; of words only those that are not broadcast, for their ids and back."""
    docs = spark.createDataFrame([(i, "the herons waded") for i in range(50)], "doc_id long, text string")
    plan = bpe.encode_documents(docs, tokenizer)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if " Exchange hashpartitioning(" in line and "g_" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in exchanges) == 2  # one, used twice
    assert len(exchanges) <= 4, plan  # and keys, and ids of rare words


def test_partitions_grow_with_the_words(spark, tokenizer, rows, monkeypatch):
    monkeypatch.setattr(bpe, "PARTITION_WORDS", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    got = bpe.encode_documents(docs, tokenizer)
    words = bpe.dictionary(docs, tokenizer).agg(F.sum("n")).first()[0]
    assert f", {words // 100}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and words > 400
    assert sorted(str((r.doc_id, r.other, r.ids)) for r in got.collect()) == sorted(str((d, o, tokenizer.encode(t or ""))) for d, t, o in rows)
