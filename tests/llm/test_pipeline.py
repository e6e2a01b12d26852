import hashlib

import pytest

import corpus_pipeline
from corpusmill.llm import bpe

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, docs, DATA).schema)
        out.append(docs.collect())
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "bpe"]
    assert all(tuple(rows[0].__fields__) == ("doc_id", "text", "lang", "source", "n_chars") for rows in steps[:5])


def test_stages_against_brute_force(spark, steps):
    from corpusmill.llm import toxicity
    from test_neardup import brute
    from tests_llm_helpers import brute_lines, brute_overlaps

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, weights, bias = toxicity.train(docs, labels)
    known = dict(zip(at.tolist(), weights.tolist()))
    clean = [r for r in steps[0] if bias + sum(known.get(f, 0.0) for f in toxicity.features(r.text).tolist()) < 0]
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(clean) == ids(steps[1])
    want = brute_lines([(r.doc_id, r.text) for r in steps[1]], 50)
    assert {r.doc_id: r.text for r in steps[2]} == {d: t for (d, _), (t, left) in want.items() if left}
    assert all(r.n_chars == len(r.text) for r in steps[2])
    assert ids(steps[3]) == brute([(r.doc_id, r.text) for r in steps[2]])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_overlaps([(r.doc_id, r.text) for r in steps[3]], items)}
    assert ids(steps[4]) == sorted(r.doc_id for r in steps[3] if r.doc_id not in bad)
    for r, doc in zip(sorted(steps[5], key=lambda r: r.doc_id), sorted(steps[4], key=lambda r: r.doc_id)):
        assert r.decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and len(bpe.unpack(bytes(r.ids))) == r.n_tokens


def test_run(spark, steps):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r.doc_id for r in steps[5])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the stages use themselves."""
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, "a clean text of its own", "en", "s", 23), (None, None, None, None, None), (2, "", None, "s", 0), (3, None, "en", None, None), (4, long, "en", "s", len(long)), (5, long, "en", "s", None), (5, long, "en", "s", None), (6, "\n".join([long] * 3), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "d long, h string, d_ int, h_ int, fp string, key int, removed string, label int, score double, text_hash int, item_id int, c0_ int, TEXT string"
    docs = spark.createDataFrame([(*r, *[None] * 13) for r in rows], f"{schema}, {extra}")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        names, docs = docs.columns, stage(spark, docs, DATA)
        if name != "bpe":
            assert docs.columns == names
            docs = docs.cache()
        kept.append(sorted(str(r[0]) for r in docs.collect()))
    assert kept[0] == ["1", "2", "3", "4", "5", "5", "6", "None"]
    assert kept[1] == ["1", "2", "3", "4", "None"]  # 5 and 6 repeat the line of 4
    assert kept[2] == ["1", "4", "None"]  # texts without words are one group, whose smallest doc_id is null
    assert kept[3] == kept[4] == ["1", "4", "None"]
