import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import scaling
from corpusmill.sources import artifacts, sweeps


def test_tables(spark):
    assert [len(sweeps.rows(t)) for t in (sweeps.FIRST, sweeps.RATES, sweeps.CALIBRATED)] == [28, 23, 31]


def test_optima_and_fits(spark):
    measured = scaling.measures(sweeps.sweep(spark, sweeps.CALIBRATED))
    best = scaling.optimum(measured)
    assert {r.c: r.val_ppl for r in best.collect()} == {5e14: 65.13, 1e15: 47.82, 5e15: 32.50}
    assert all(r.interior for r in scaling.interior(measured).collect())
    ratio = scaling.power_fit(best, "c", "ratio").first().exponent
    n, d = (scaling.power_fit(best, "c", x).first().exponent for x in ("n", "tokens"))
    assert ratio == pytest.approx(-0.545, abs=0.01) and n + d == pytest.approx(1, abs=0.01) and d - n == pytest.approx(ratio)


def test_boundary_optimum(spark):
    rows = spark.createDataFrame([(1.0, n, 10, 1.0, float(n)) for n in (1, 2, 3)], "c double, n int, tokens int, ratio double, val_ppl double")
    assert not scaling.interior(rows).first().interior


def test_rates(spark):
    anchors = spark.createDataFrame([(552960, 0.0045), (3145728, 0.004), (25165824, 0.0016)], "n long, lr double")
    measured = scaling.measures(sweeps.sweep(spark, sweeps.CALIBRATED)).select("c", "n", "lr")
    rows = scaling.interpolated_rates(measured, anchors).collect()
    assert len(rows) == 31 and all(abs(r.rate - r.lr) < 0.14e-3 for r in rows)


def test_parsers(spark):
    text = ['# First', 'A heading row', '"256 6 8 1024 18000000 5.1 169.0"  # note', "", "# Second", '"512  8 8 2048 33000000 8.0e-4 4.5 99.6"', '"too few"']
    lines = spark.createDataFrame(list(enumerate(text)), "pos int, value string")
    rows = sweeps.parse_results(lines).collect()
    assert [(r.section, r.d, r.tokens, r.lr, r.val_ppl) for r in rows] == [("First", 256, 18000000, None, 169.0), ("Second", 512, 33000000, 0.0008, 99.6)]
    configs = spark.createDataFrame([('    "96   5  3  384   1506000000    4.5e-3"   # n',), ('  "64 2 2 256"',), ("echo",)], "value string")
    assert [tuple(r) for r in sweeps.parse_configs(configs).collect()] == [(96, 5, 3, 384, 1506000000, 0.0045), (64, 2, 2, 256, None, None)]


def test_artifacts(spark, tmp_path):
    base = f"file://{tmp_path}"
    log = spark.createDataFrame([(50, 500, 1.23456789, 3.0, math.inf, 0.0012)], artifacts.LOG)
    artifacts.write_log(log, f"{base}/log")
    assert tuple(artifacts.read_log(spark, f"{base}/log").first()) == (50, 500, 1.234568, 3.0, math.inf, 0.0012)
    artifacts.write_log(log.drop("lr"), f"{base}/short")
    assert artifacts.read_log(spark, f"{base}/short").first().lr is None
    for i, extra in enumerate(('"early_stop": 3', '"token_budget": 5, "best_val_ppl": Infinity')):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "run_config_x.json").write_text('{\n "seed": 42,\n "training": {"batch_size": 32, %s},\n "generation": [{"prompt": "a", "output": "b"}]\n}' % extra)
    rows = artifacts.read_run_configs(spark, f"{base}/run*/run_config_*.json").orderBy("file").collect()
    assert [(r.training.early_stop, r.training.token_budget) for r in rows] == [(3, None), (None, 5)] and rows[1].training.best_val_ppl == math.inf
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert artifacts.cached(spark, f"{base}/kept", make).count() == artifacts.cached(spark, f"{base}/kept", make).count() == 3 and len(made) == 1
    assert artifacts.overridden({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}


def test_run_name(spark):
    row = spark.sql("SELECT TIMESTAMP'2024-03-09 07:05:01.9' AS at").select(artifacts.run_name(F.col("at")).alias("n")).first()
    assert row.n == "20240309_070501"
