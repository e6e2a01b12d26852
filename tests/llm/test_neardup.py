import random

import numpy as np
import pytest

import corpus_pipeline
from corpusmill.llm import neardup


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each component of texts whose five-word shingles agree by 0.8 or more."""
    sets, left, first = {d: plain_shingles(t) for d, t in rows}, {d for d, _ in rows}, []
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    while left:
        todo = [min(left)]
        first.append(todo[0])
        left.discard(todo[0])
        while todo:
            own = sets[todo.pop()]
            hit = {d for d in left if near(own, sets[d])}
            left -= hit
            todo += hit
    return first


def texts(seed, n):
    """Chains of edited copies, texts that share a line, short texts and far ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    line, out = [word() for _ in range(30)], []
    for _ in range(n):
        if out and r.random() < 0.6:
            own = list(r.choice(out[-15:]))
            for _ in range(r.randrange(0, 1 + max(1, len(own) // 30))):
                own[r.randrange(len(own))] = word()
        else:
            own = [word() for _ in range(r.choice([1, 3, 5, 6, 20, 60, 200]))] + (line if r.random() < 0.5 else [])
        out.append(own)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("text", [None, "", "one", "a b c d", "a b c d e", "A b c d e f a b c d e f", "w " * 50])
def test_shingles(text):
    assert len(neardup.shingles(text)) == len(plain_shingles(text))


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 40, r.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.92], r.integers(0, 1 << 40, r.integers(0, 5)).astype(np.uint64)]))
        often = np.sort(r.choice(a, len(a) // 2, replace=False))
        count = r.integers(3, 9, len(often))
        if neardup.similar(a, b):
            both = len(np.intersect1d(a, b))
            assert len(np.intersect1d(neardup.prefix(a, often, count), neardup.prefix(b, often, count))) >= min(neardup.K, both)


@pytest.mark.parametrize("often, small, group", [(1, 64, 50_000), (3, 2, 50_000), (3, 2, 7)])
def test_stage_equals_brute_force(spark, often, small, group, monkeypatch):
    monkeypatch.setattr(neardup, "OFTEN", often)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "GROUP", group)
    rows = texts(often, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == brute(rows)


def test_a_copy_with_a_few_changed_words_goes(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10_000)}" for _ in range(300)]
    edited = list(words)
    for i in (30, 90, 150, 210, 270):
        edited[i] = "changed"
    docs = spark.createDataFrame([(4, " ".join(words)), (2540, " ".join(edited))], "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [4]


def test_given_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == brute(rows)


@pytest.mark.parametrize("at_once", [5, 1 << 20])
def test_runs_of_keys_over_batches(at_once, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "AT_ONCE", at_once)
    r = np.random.default_rng(2)
    rows = sorted((int(k), int(x)) for k, x in zip(r.integers(0, 12, 200), r.integers(0, 30, 200)))
    rows += [(50, i) for i in range(40)]
    batches = [pa.record_batch([pa.array([k for k, _ in rows[i : i + 7]]), pa.array([x for _, x in rows[i : i + 7]])], ["key", "rep"]) for i in range(0, len(rows), 7)]
    got = {}
    for (key, rep), starts, ends, goes_on in neardup._runs(iter(batches)):
        for i, (s, e) in enumerate(zip(starts, ends)):
            assert (key[s] in got) == (goes_on and i == 0)
            got.setdefault(int(key[s]), []).append(rep[s:e].tolist())
    want = {}
    for k, x in sorted(set(rows)):
        want.setdefault(k, []).append(x)
    assert {k: sorted({x for part in v for x in part}) for k, v in got.items()} == want
    if at_once > 1000:
        assert all(len(v) == 1 and len(v[0]) == len(want[k]) for k, v in got.items())


def test_parities_bound_the_difference():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(0, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, r.integers(0, 30)).astype(np.uint64)]))
        apart = int(np.bitwise_count((neardup.parity(a) ^ neardup.parity(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))
