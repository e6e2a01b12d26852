import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bpe, stream
from corpusmill.sources import artifacts, formats


@pytest.fixture(autouse=True)
def registered(spark):
    formats.register(spark)


def files(path):
    return sorted(p.name for p in path.iterdir()) if path.exists() else []


def test_tokens_of_documents_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = stream.byte_tokens(docs, 256).repartition(3)
    where = f"file://{tmp_path}/t"
    tokens.write.format("corpusmill_tokens").option("tokenizer", "abc").mode("append").save(where)
    read = spark.read.format("corpusmill_tokens").load(where)
    assert read.rdd.getNumPartitions() == 3
    key = lambda r: r.doc_id
    assert sorted(read.collect(), key=key) == sorted(tokens.collect(), key=key)
    tokens.limit(5).write.format("corpusmill_tokens").option("tokenizer", "abc").mode("append").save(where)
    assert spark.read.format("corpusmill_tokens").option("tokenizer", "abc").load(where).count() == docs.count() + 5
    with pytest.raises(Exception, match="belong to tokenizer"):
        spark.read.format("corpusmill_tokens").option("tokenizer", "xyz").load(where).collect()
    with pytest.raises(Exception, match="belongs to"):
        tokens.limit(1).write.format("corpusmill_tokens").option("tokenizer", "xyz").mode("append").save(where)
    assert spark.read.format("corpusmill_tokens").load(where).count() == docs.count() + 5
    tokens.limit(2).write.format("corpusmill_tokens").option("tokenizer", "xyz").mode("overwrite").save(where)
    assert spark.read.format("corpusmill_tokens").option("tokenizer", "xyz").load(where).count() == 2
    assert len(files(tmp_path / "t")) == len(json.loads((tmp_path / "t/_committed.json").read_text())["files"]) + 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    tokens = spark.range(40).repartition(4).select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("ids"))
    where = f"file://{tmp_path}/t"
    bad = tokens.withColumn("doc_id", F.when(F.col("doc_id") == 37, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("doc_id")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("corpusmill_tokens").mode("append").save(where)
    with pytest.raises(Exception, match="nothing is committed"):
        spark.read.format("corpusmill_tokens").load(where).collect()
    formats.swept(where)
    assert files(tmp_path / "t") == []
    tokens.write.format("corpusmill_tokens").mode("append").save(where)
    before = files(tmp_path / "t")
    with pytest.raises(Exception, match="lost"):
        bad.write.format("corpusmill_tokens").mode("overwrite").save(where)
    formats.swept(where)
    assert files(tmp_path / "t") == before and spark.read.format("corpusmill_tokens").load(where).count() == 40


def test_stray_files_are_not_read(spark, tmp_path):
    tokens = spark.range(10).select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("ids"))
    tokens.write.format("corpusmill_tokens").mode("append").save(f"file://{tmp_path}/t")
    (tmp_path / "t/part-lost.parquet").write_bytes(b"half a file")
    assert spark.read.format("corpusmill_tokens").load(f"file://{tmp_path}/t").count() == 10


def test_a_tokenizer_is_one_document_that_the_package_loads(spark, tmp_path):
    merges = [(b"t", b"h"), (b"th", b"e"), (b"\xc3", b"\xa9")]
    rows = spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(merges)], "rank int, l string, r string").repartition(3)
    where = f"file://{tmp_path}/tok"
    rows.write.format("corpusmill_tokenizer").option("specials", "<|endoftext|>\n<|pad|>").mode("append").save(where)
    assert sorted(map(tuple, spark.read.format("corpusmill_tokenizer").load(where).collect())) == sorted(map(tuple, rows.collect()))
    names = [n for n in files(tmp_path / "tok") if n.startswith("part-")]
    assert len(names) == 1
    loaded = artifacts.load_tokenizer(spark, f"{where}/{names[0]}")
    made = bpe.Tokenizer.from_merges(merges, ["<|endoftext|>", "<|pad|>"])
    assert artifacts.fingerprint(loaded) == artifacts.fingerprint(made)
    with pytest.raises(Exception, match="overwritten, not added to"):
        rows.write.format("corpusmill_tokenizer").mode("append").save(where)


def test_logs_with_and_without_a_rate(spark, tmp_path):
    full = spark.createDataFrame([(1, 9, 1.23456789, 3.0, 2.5, 0.00123), (2, 9, float("nan"), 1e9, float("inf"), None)], "step int, total_steps int, loss double, train_ppl double, val_ppl double, lr double")
    where = f"file://{tmp_path}/log"
    full.coalesce(1).write.format("corpusmill_log").mode("append").save(where)
    full.drop("lr").where("step = 1").write.format("corpusmill_log").mode("append").save(where)
    got = sorted(map(str, map(tuple, spark.read.format("corpusmill_log").load(where).collect())))
    assert got == sorted(map(str, [(1, 9, 1.234568, 3.0, 2.5, 0.00123), (2, 9, float("nan"), 1e9, float("inf"), None), (1, 9, 1.234568, 3.0, 2.5, None)]))


def test_a_task_of_many_tokens_holds_few(tmp_path):
    """Writing and reading 400 MB of ids in one task each takes little memory beside a batch."""
    import subprocess
    import sys

    code = f"""
import resource, numpy as np, pyarrow as pa
from corpusmill.sources import formats
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
r = np.random.default_rng(1)
def batches():
    for i in range(25):
        ids = pa.array(r.integers(0, 1 << 31, 4_000_000, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.ListArray.from_arrays(np.arange(0, 4_000_001, 4000, dtype=np.int32), ids)], ["doc_id", "ids"])
writer = formats.TokenWriter({{"path": "{tmp_path}/t"}}, True)
before = peak()
said = writer.write(batches())
writer.commit([said])
reader = formats.TokenReader({{"path": "{tmp_path}/t"}})
rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
print(said.rows, rows, peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parent.parent)).stdout
    wrote, read, grown = map(int, out.split()[-3:])
    assert wrote == read == 25_000 and grown < 250, out
