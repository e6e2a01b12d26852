import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import blocks, model


def sequences(spark, lengths, d=6, seed=1):
    r = np.random.default_rng(seed)
    rows = [(s, h, t, r.normal(0, 3, d).tolist()) for s, n in enumerate(lengths) for h in range(2) for t in range(n)]
    return spark.createDataFrame(rows, "seq long, head int, t long, x array<double>").repartition(5)


def plain(rows, causal):
    out = {}
    for s, h in {(r.seq, r.head) for r in rows}:
        own = sorted((r for r in rows if (r.seq, r.head) == (s, h)), key=lambda r: r.t)
        x = np.array([r.x for r in own])
        score = x @ x.T / np.sqrt(x.shape[1])
        if causal:
            score[np.triu_indices(len(x), 1)] = -np.inf
        p = np.exp(score - score.max(axis=1, keepdims=True))
        out.update({(s, h, r.t): v for r, v in zip(own, p / p.sum(axis=1, keepdims=True) @ x)})
    return out


@pytest.mark.parametrize("block, lanes, causal", [(1, 1, True), (3, 2, True), (3, 8, False), (64, 8, True)])
def test_online_softmax_equals_the_whole(spark, block, lanes, causal):
    x = sequences(spark, [1, 2, 7, 40])
    got = {(r.seq, r.head, r.t): r.o for r in blocks.blockwise_attention(x, block, causal=causal, lanes=lanes).collect()}
    want = plain(x.collect(), causal)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)


def test_equal_to_the_rows_of_pairs(spark):
    x = sequences(spark, [5, 20], seed=2)
    pairs = model.attend(model.attention(model.attention_scores(x)), x)
    want = {(r.seq, r.head, r.t, r.dim): r.o for r in pairs.collect()}
    made = blocks.blockwise_attention(x, 4).select("seq", "head", "t", F.posexplode("o").alias("dim", "o"))
    got = {(r.seq, r.head, r.t, r.dim): r.o for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_extreme_scores_and_empty_tables(spark):
    rows = [(0, 0, t, [v, 0.0]) for t, v in enumerate([1e3, -1e3, 1e3, 0.0])]
    x = spark.createDataFrame(rows, "seq long, head int, t long, x array<double>")
    got = {r.t: r.o for r in blocks.blockwise_attention(x, 1).collect()}
    want = plain(x.collect(), True)
    assert all(np.allclose(got[t], want[0, 0, t], atol=1e-9) for t in got) and len(got) == 4
    assert blocks.blockwise_attention(x.where("false"), 2).count() == 0


def test_shuffled_rows_are_linear_in_positions(spark):
    """No row is made for a pair of positions: the join gets rows of blocks."""
    x = sequences(spark, [64])
    plan = blocks.blockwise_attention(x, 8, lanes=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Window" not in plan
    assert "collect_list(struct(t" in plan.split("Join Inner")[1]


@pytest.mark.parametrize("inputs, outputs, tile", [(1, 1, 4), (5, 3, 4), (8, 8, 4), (9, 17, 4)])
def test_tiles_equal_numpy(spark, inputs, outputs, tile):
    r = np.random.default_rng(inputs)
    w, b, x = r.normal(size=(outputs, inputs)), r.normal(size=outputs), r.normal(size=(11, inputs))
    table = spark.createDataFrame([(o, i, float(w[o, i])) for o in range(outputs) for i in range(inputs)], "o long, i long, w double")
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key long, x array<double>").repartition(3)
    bias = spark.createDataFrame([(o, float(v)) for o, v in enumerate(b)], "o long, b double")
    got = {r.key: r.y for r in blocks.tiled_linear(rows, table, outputs, bias, tile=tile, group=4).collect()}
    assert all(np.allclose(got[k], x[k] @ w.T + b, atol=1e-9) for k in range(11)) and len(got) == 11


def test_real_widths_and_a_plan_that_does_not_grow(spark):
    """512 inputs, 2048 outputs, from the given vectors."""
    vectors = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").collect()])
    flat = vectors.reshape(-1)
    w = np.resize(flat, 2048 * 512).reshape(2048, 512)
    x = np.resize(flat[::-1], 20 * 512).reshape(20, 512)
    import pandas as pd

    o, i = np.divmod(np.arange(2048 * 512), 512)
    table = spark.createDataFrame(pd.DataFrame({"o": o, "i": i, "w": w.reshape(-1)})).repartition(4)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key long, x array<double>")
    wide = blocks.tiled_linear(rows, table, 2048)
    got = {r.key: r.y for r in wide.collect()}
    assert all(np.allclose(got[k], x[k] @ w.T, atol=1e-9) for k in range(20))
    narrow = blocks.tiled_linear(rows, table.where("o < 3 AND i < 2"), 3)
    size = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert abs(size(wide) - size(narrow)) <= 3


@pytest.mark.parametrize("size", [1, 3, 50])
def test_loss_over_slices_equals_the_whole(spark, size):
    r = np.random.default_rng(size)
    z = r.normal(0, 200, (9, 40))
    target = r.integers(0, 40, 9)
    slices = spark.createDataFrame([(k, i, z[k, i : i + size].tolist()) for k in range(9) for i in range(0, 40, size)] + [(0, 40, [])], "key long, first long, z array<double>").repartition(4)
    targets = spark.createDataFrame([(k, int(t)) for k, t in enumerate(target)] + [(99, 1)], "key long, target long")
    got = {x.key: x.loss for x in model.split_cross_entropy(slices, targets).collect()}
    top = z.max(axis=1)
    want = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(9), target]
    assert got.keys() == set(range(9)) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert model.split_cross_entropy(slices, spark.createDataFrame([(1, 77)], "key long, target long")).first().loss is None
