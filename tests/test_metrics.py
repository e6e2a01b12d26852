import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics

NAN, INF = float("nan"), float("inf")


def brute(values, patience):
    best, stale, rows = INF, 0, []
    for v in values:
        improved = v < best
        best, stale = (v, 0) if improved else (best, stale + 1)
        rows.append((improved, stale))
        if patience and stale >= patience:
            break
    return rows


@pytest.mark.parametrize("values", [[3.0, 2.0, 2.0, NAN, 1.0, 5.0, 5.0, 5.0, 0.5], [NAN, NAN, 1.0], [NAN] * 4, [1.0], [2.0, 2.0, 2.0], [5.0, 4.0, 3.0]])
@pytest.mark.parametrize("patience", [0, 1, 2, 3])
def test_early_stop(spark, values, patience):
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step int, v double")
    best = metrics.running_best(log, "v", ["step"], ["run"])
    rows = metrics.early_stop(best, patience, ["step"], ["run"]).orderBy("step").collect()
    assert [(r.improved, r.stale) for r in rows] == brute(values, patience)


@pytest.mark.parametrize("buckets", [1, 7])
def test_blocks_change_nothing(spark, buckets):
    """Random logs with NaN, nulls, ties, null runs and null steps; one run holds most rows; against the definition, row by row."""
    import random

    r = random.Random(buckets)
    rows = [(r.choice(["a", "a", "a", "a", "b", None]), i if r.random() < 0.97 else None, i, r.choice([NAN, None, *(float(r.randrange(1000 - i)) for _ in range(6))])) for i in range(900)]
    log = spark.createDataFrame(rows, "run string, step int, id int, v double").repartition(5)
    order = ["step", "id"]
    found = metrics.running_best(log, "v", order, ["run"], buckets)
    for patience in (0, 4):
        got = {row.id: (row.improved, row.best, row.stale) for row in metrics.early_stop(found, patience, order, ["run"], buckets).collect()}
        want = {}
        for run in ("a", "b", None):
            best, stale = None, 0
            for _, _, i, v in sorted((x for x in rows if x[0] == run), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
                better = v is not None and v == v and (best is None or v < best)
                best, stale = (v, 0) if better else (best, stale + 1)
                want[i] = (better, best, stale)
                if patience and stale >= patience:
                    break
        assert got == want
    spread = metrics._blocks(log, ["run"], order, buckets).where("run = 'a'").groupBy("block_").count().collect()
    assert len(spread) >= buckets and max(x["count"] for x in spread) < 900 / buckets


def test_perplexity_weighs_batches_equally(spark):
    losses = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "g string, i int, v double")
    got = metrics.perplexity(metrics.batch_means(losses, "v", F.floor(F.col("i") / 2), ["g"]), ["g"]).first().ppl
    assert got == pytest.approx(math.exp((0.5 + 2.5 + 4) / 3))


@pytest.mark.parametrize("budget,steps", [(0, 10), (1, 1), (64, 1), (65, 2), (640, 10), (10_000, 10)])
def test_budget(spark, budget, steps):
    log = spark.range(1, 11).withColumnRenamed("id", "step")
    assert metrics.within_budget(log, budget, 8, 8).count() == steps


def test_schedule(spark):
    rows = metrics.schedule(spark, 200, 1.0).orderBy("step").collect()
    assert rows[0].lr == pytest.approx(1e-5 + (1 - 1e-5) / 4)
    assert rows[3].lr == pytest.approx(1.0)
    assert rows[-1].lr == pytest.approx(0.1)
    assert all(a.lr >= b.lr for a, b in zip(rows[3:], rows[4:]))
    assert metrics.schedule(spark, 1, 1.0).count() == 1


def test_counts(spark):
    n = spark.createDataFrame([(1, 5), (2, 4)], "doc_id long, n long")
    assert tuple(metrics.counts(n, 4, 32).first()) == (2, 9, 2, 1)
    assert tuple(metrics.counts(n.where("false"), 4, 32).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("f,name", [(lambda d: metrics.running_best(d, "loss", ["step"], ["run"]), "BEST"), (lambda d: metrics.early_stop(d, 2, ["step"], ["run"]), "stale")])
def test_clashing_names_raise(spark, f, name):
    with pytest.raises(ValueError, match="adds itself"):
        f(spark.createDataFrame([(1, 1, 2.0, 3)], f"run int, step int, loss double, {name} int"))
