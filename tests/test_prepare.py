from corpusmill.plans.prepare import prepare
from corpusmill.streaming import words

DATA = "/root/testdata/sf0.001"


def test_prepare_equals_flat_lists(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _ in range(2):  # the second time from what is kept
        made = prepare(spark, docs, f"file://{tmp_path}", num_docs=30, vocab_size=300, block=64, batch=8, most_val=900)
    texts = [r.text for r in docs.orderBy("doc_id").limit(30).collect()]
    flat = [i for t in texts for i in made.tokenizer.encode(t + "<|endoftext|>")]
    border = len(flat) - min(900, len(flat) // 10)
    cut = lambda s: [(s[i : i + 64], s[i + 1 : i + 65]) for i in range(0, (len(s) - 1) // 64 * 64, 64)]
    assert [(r.x, r.y) for r in made.train.orderBy("chunk_id").collect()] == cut(flat[:border])
    assert [(r.x, r.y) for r in made.val.orderBy("chunk_id").collect()] == cut(flat[border:])
    assert made.train.groupBy("batch_id").count().where("count > 8").isEmpty()


def test_streamed_words_equal_the_batch(spark, tmp_path):
    source = f"{DATA}/documents.parquet"
    batch = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    batch.repartition(4).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    streamed = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    running = words.to_table(words.word_counts(streamed), "streamed_words", f"file://{tmp_path}/state").start()
    running.processAllAvailable()
    running.stop()
    assert {tuple(r) for r in spark.table("streamed_words").collect()} == {tuple(r) for r in words.word_counts(batch).collect()}
