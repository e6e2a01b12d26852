import pytest

from corpusmill.functions import tables
from corpusmill.functions import text as T
from corpusmill.operators import bpe
from corpusmill.sources import artifacts

END = "<|endoftext|>"


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, f"a{END}b  é\n日")], "doc_id long, text string")).cache()
    docs.createOrReplaceTempView("some_documents")
    tokenizer = bpe.Tokenizer.train(docs, 257 + 30, [END])
    path = f"file://{tmp_path_factory.mktemp('t')}/tokenizer"
    artifacts.save_tokenizer(spark, tokenizer, path)
    tables.register(spark)
    words = docs.select("doc_id", F.posexplode(T.pretokens(F.col("text"))).alias("at", "word"))
    return docs, tokenizer, path, words


def test_pretokens_from_sql_equal_the_columns(spark, ready):
    got = spark.sql("SELECT doc_id, t.at, t.word FROM some_documents, LATERAL pretokens(text) t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ready[3].collect()))


@pytest.mark.parametrize("end", [None, END])
def test_ids_from_sql_equal_the_documents_ids(spark, ready, end):
    docs, tokenizer, path, _ = ready
    last = "" if end is None else f", '{end}'"
    rows = spark.sql(f"SELECT doc_id, t.* FROM some_documents, LATERAL token_ids(text, '{path}'{last}) t").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.at):
        got.setdefault(r.doc_id, []).append(r.id)
        assert bytes(r.token) == tokenizer.vocab[r.id]
    want = {r.doc_id: r.ids for r in bpe.encode_documents(docs, tokenizer, end=end).collect()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("call, message", [("pretokens(1)", "text must be a string"), ("token_ids('a', 5)", "path must be a string"), ("token_ids('a', '{path}', 'nothing')", "no special token")])
def test_wrong_arguments_fail_before_anything_runs(spark, ready, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM {call.format(path=ready[2])}").schema
