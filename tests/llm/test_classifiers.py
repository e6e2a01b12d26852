import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import quality, toxicity
from corpusmill.llm.words import word_hashes


def brute_score(text, model):
    """Sum of weights over the distinct features, one text at a time."""
    at, weights, bias = model
    known = dict(zip(at.tolist(), weights.tolist()))
    total = bias + sum(known.get(f, 0.0) for f in toxicity.features(text).tolist())
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(900):
        words = r.choices(pool, k=r.randrange(20, 120))
        bad, poor = r.random() < 0.2, r.random() < 0.25
        if bad:
            words[r.randrange(len(words))] = r.choice(["vile", "nasty", "horrid"])
            words[r.randrange(len(words))] = r.choice(["vile", "nasty", "horrid"])
        text = " ".join(words)
        rows.append((i, "!! ".join(text.upper().split()) if poor else text, 1))
        if i % 10:
            labels.append((i, int(not poor), int(bad), "x"))
    rows += [(1000, None, 1), (1001, "", 1), (None, "vile nasty", 1), (5, "twice", 1), (1002, "w1 " * 50_000, 1)]
    labels += [(None, 1, 1, "x"), (3, None, None, "x"), (77_777, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), rows, labels


def judged(out, labels, column):
    truth = {r[0]: r[column] for r in labels if r[0] is not None and r[column] is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    return sum(p == y for p, y in held) / len(held)


def shape(out, rows):
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity(corpus):
    docs, labels, rows, known = corpus
    out = toxicity.score_toxicity(docs, labels).collect()
    shape(out, rows)
    assert judged(out, known, 2) > 0.95
    model = toxicity.train(docs, labels)
    assert 0 < len(model[0]) < 2000  # sparse
    texts = {(r[0], r[1]) for r in rows}
    scores = {}
    for r in toxicity.score(docs, model).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    for d, t in texts:
        assert any(s == pytest.approx(brute_score(t, model), abs=1e-5) for s in scores[d])
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_held_out_labels_are_never_read(corpus, spark):
    docs, labels, _, _ = corpus
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) toxic", "text")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2] == b[2]


def test_quality(corpus):
    docs, labels, rows, known = corpus
    out = quality.score_quality(docs, labels).collect()
    shape(out, rows)
    assert judged(out, known, 1) > 0.95


def test_without_labels(corpus):
    docs, labels, _, _ = corpus
    none, ones = labels.where("false"), labels.where("toxic = 1")
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert {r.predicted for r in toxicity.score_toxicity(docs, ones).collect()} == {1}
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0
    assert quality.score_quality(docs.where("false"), labels).count() == 0


def test_ftrl_rates_and_sparsity():
    r = np.random.default_rng(0)
    examples = []
    for _ in range(400):
        x = r.choice(1000, 10, replace=False).astype(np.uint32) + 10
        y = int(r.random() < 0.5)
        examples.append((np.append(x, 3).astype(np.uint32) if y else x, y))
    at, weights, _ = toxicity.fit(examples)
    assert 3 in at and len(at) < 300 and weights[list(at).index(3)] > 1


def test_features_stay_within_a_document():
    a, b = word_hashes("one two"), word_hashes("three")
    joined_words = set(toxicity.features("one two three").tolist())
    apart = set(toxicity.features("one two").tolist()) | set(toxicity.features("three").tolist())
    assert apart < joined_words and len(joined_words - apart) == 2 and len(a) == 2 and len(b) == 1


def test_network_gradients_are_right():
    r = np.random.default_rng(1)
    net = quality.fit([(bytes(r.integers(32, 127, 400).astype(np.uint8)), k % 2) for k in range(8)], epochs=1)
    for part in ("vectors", "filters", "offsets", "out"):
        setattr(net, part, getattr(net, part).astype(np.float64))
    texts, labels = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (0, 5, 130, 700, 1500)], np.array([1, 0, 1, 0, 1.0])
    grads, _ = quality.gradients(net, texts, labels)
    for part, grad in zip(("vectors", "filters", "offsets", "out"), grads):
        values = getattr(net, part)
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in values.shape)
            kept, losses = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                losses.append(quality.gradients(net, texts, labels)[1])
            values[at] = kept
            assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-4)


def plain_forward(net, text):
    """One window after another."""
    data = np.zeros(((len(text) + quality.WIDTH) // quality.BLOCK + 1) * quality.BLOCK + quality.WIDTH, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    blocks = (len(data) - quality.WIDTH) // quality.BLOCK
    tops = np.full((blocks, quality.FILTERS), -np.inf)
    for at in range(0, blocks * quality.BLOCK, quality.STRIDE):
        tops[at // quality.BLOCK] = np.maximum(tops[at // quality.BLOCK], net.vectors[data[at : at + quality.WIDTH]].ravel() @ net.filters)
    chunks, at = [], 0
    while True:
        chunks.append(np.maximum(tops[at : at + quality.CHUNK].max(axis=0) + net.offsets, 0))
        if at + quality.CHUNK >= blocks:
            break
        at += quality.CHUNK // 2
    chunks = np.array(chunks)
    return 1 / (1 + np.exp(-(np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.out[:-1] + net.out[-1])))


def test_chunks_cover_the_whole_text():
    r = np.random.default_rng(2)
    net = quality.fit([(bytes(r.integers(32, 127, 300).astype(np.uint8)), k % 2) for k in range(8)], epochs=1)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 119, 120, 121, 500, 640, 2000, 5001)]
    assert quality.forward(net, texts) == pytest.approx([plain_forward(net, t) for t in texts], abs=1e-4)


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    r = np.random.default_rng(3)
    net = quality.fit([(bytes(r.integers(32, 127, 300).astype(np.uint8)), k % 2) for k in range(8)], epochs=1)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (3000, 0, 700, 128 * 5 - 8, 128 * 5 - 7)]
    want = [plain_forward(net, t) for t in texts]
    for blocks in (1, 2, 3, 7):
        monkeypatch.setattr(quality, "PIECE", blocks)
        assert quality.forward(net, texts) == pytest.approx(want, abs=1e-4)


def test_long_text_is_scored_alike_in_any_blocks(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choices(["vile", "a", "b", "c", "nasty"], k=n)) for n in (500, 0, 7, 300)]
    model = np.unique(np.concatenate([toxicity.features(t)[::3] for t in texts])), None, -0.5
    model = model[0], np.linspace(-1, 1, len(model[0])).astype(np.float32), -0.5
    for words in (3, 10, 64, 10_000):
        monkeypatch.setattr(toxicity, "BATCH_WORDS", words)
        assert toxicity.Scorer(model).of_words([word_hashes(t) for t in texts]) == pytest.approx([brute_score(t, model) for t in texts], abs=1e-5)


def test_bounds_of_the_sample_hold(spark):
    """A doc_id that very many rows repeat, and a text of 24 MB among the first: neither fills nor empties the sample."""
    docs = spark.range(50_000).selectExpr("7L doc_id", "'repeated words here' text")
    docs = docs.unionAll(spark.range(200).selectExpr("id doc_id", "IF(id % 2 = 0, repeat('fine prose of some kind. ', 40), repeat('zz!!## ', 60)) text"))
    docs = docs.unionAll(spark.range(1000, 1010).selectExpr("id doc_id", "repeat('a very long text ', 1500000) text").where("doc_id = 1001"))
    labels = spark.range(1, 200).selectExpr("id doc_id", "CAST(id % 2 AS INT) toxic", "CAST((id + 1) % 2 AS INT) quality").unionAll(spark.sql("SELECT 1001L, 1, 1"))
    labels = labels.unionAll(labels)
    rows = toxicity.labelled(docs, labels, "toxic", 100, 1 << 20).select("doc_id", "label", "text_hash", F.octet_length("text").alias("n")).distinct().collect()
    assert 90 <= len(rows) <= 100 and len({(r.doc_id, r.label) for r in rows}) == len(rows)
    assert sum(r.n for r in rows) <= 1 << 20 and max(r.n for r in rows) <= (1 << 20) // toxicity.LARGEST
    net = quality.train(docs, labels)
    assert not isinstance(net, float)
    held = quality.score_quality(docs.where("doc_id < 200 OR doc_id = 1001"), labels).where("doc_id NOT IN (7, 1001)").collect()
    assert sum(r.predicted == (r.doc_id + 1) % 2 for r in held) > 0.95 * len(held)
    assert toxicity.score_toxicity(docs.where("doc_id = 1001"), labels).count() == 1


def test_memory_of_a_text_of_50_mb():
    """Scores of one very long text, in a process of its own: peak memory less that of the text itself."""
    code = """
import resource, numpy as np, pyarrow as pa
from corpusmill.llm import quality, toxicity
from corpusmill.llm.words import word_hashes
net = quality.fit([(b'abc' * 50, 0), (b'xyz' * 50, 1)], epochs=1)
text = pa.array(['some words of a long text, ' * 1_900_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert 0 <= quality.scores(net, text)[0] <= 1
model = toxicity.features('some words')[:2], np.ones(2, np.float32), 0.0
assert 0 <= toxicity.Scorer(model)(text)[0] <= 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=str(Path(__file__).parents[2])).stdout)
    assert used < 900, used
