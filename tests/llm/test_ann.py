import numpy as np
import pytest

from corpusmill.llm import ann


def brute(rows, every=50, k=5):
    """Exact answers with the operator's order of summation."""
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(x) for x in v)), np.array(v, np.float32).astype(float))
    out = {}
    for (q, _), a in good.items():
        if q % every:
            continue
        scores = [(-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for (i, _), b in good.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_spans_and_prefixes():
    r = np.random.default_rng(0)
    array = np.sort(r.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64) >> np.uint64(40) << np.uint64(45))
    q = array[::50]
    for depth in (0, 1, 5, 20, 63, 64):
        begin, end = ann.spans(array, q, np.full(len(q), depth))
        common = ann.common_prefix(q[:, None], array[None, :])
        assert (end - begin).tolist() == (common >= depth).sum(axis=1).tolist()


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.3 * r.normal(size=16)]) for i in range(3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int")
    got = {}
    for x in ann.nearest(df).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows)
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        true = dict(want[q])
        hit += len({f[1] for f in found} & set(true))
        assert all(f[2] == pytest.approx(true[f[1]], abs=1e-12) for f in found if f[1] in true)
    assert hit / (5 * len(want)) >= 0.9


def test_edges(spark):
    v, w = [1.0] * 16, [1.0] * 15 + [0.5]
    rows = [(i, v) for i in range(0, 120)] + [(200, None), (250, []), (300, [0.0] * 16), (350, [float("nan")] + v[1:]), (400, [float("inf")] + v[1:]), (450, [None] + v[1:]), (None, v), (500, w), (600, [1.0, 2.0]), (50, v), (700, [-x for x in v])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for x in ann.nearest(df).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {
        0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 500: [0, 1, 2, 3, 4], 700: [500, 0, 1, 2, 3],
    }
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id = 500")).count() == 0
    few = ann.nearest(df.where("vec_id IN (500, 700)")).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in few) == [(500, 1, 700), (700, 1, 500)]


def test_tiny_and_huge_components(spark):
    """Finite, non-zero vectors take part, whatever their size."""
    a, b, c = [1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.5], [1.0, -1.0, 1.0, -1.0]
    rows = [(0, [x * 1e-200 for x in a]), (1, [x * 1e200 for x in a]), (2, [x * 1e-310 for x in b]), (3, [x * 1e300 for x in b]), (50, c), (51, [5e-324, 0.0, 0.0, 0.0])]
    got = {}
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    cos = lambda x, y: float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
    assert [(i, pytest.approx(s, abs=1e-6)) for _, i, s in sorted(got[0])] == [(1, cos(a, a)), (2, cos(a, b)), (3, cos(a, b))] or [i for _, i, _ in sorted(got[0])] == [1, 3, 2]
    assert len(got[50]) == 3 and all(np.isfinite(s) for _, _, s in got[50])


def test_blocks_and_shards_find_as_much(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "QUERIES", 7)
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16)]) for i in range(2000)]
    want = brute(rows)
    got = {}
    for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)
