"""Studies over many paths: one path against its published figures, and the key's independence."""

import pytest
from pyspark.sql import functions as F

from bench import CONFIG
from latentspark.operators import costs
from latentspark.operators import evaluation as e
from latentspark.plans import study
from latentspark.sources import dgp
from tests.helpers import series

SMALL = CONFIG | {"train_min_days": 260, "refit_days": 120, "em_max_iter": 30, "momentum_lookback": 60}


@pytest.fixture(scope="module")
def published(spark):
    return dgp.paths(spark, [19], ["base"], 2000, 10).persist()


def test_published_path(published):
    #: The published figures of the path of seed 19, to their printed digits.
    r = study.evaluate_paths(published, CONFIG).first()
    assert [round(r[g], 2) for g in ("unfiltered", "hmm", "constant", "vol", "ewma", "oracle")] == [0.54, 0.99, 0.54, 0.81, 0.79, 1.23]
    assert (r["break_even_status"], round(r["break_even"], 2)) == ("crossed", 11.54)
    assert [round(100 * r["accuracy"], 1), round(100 * r["majority_accuracy"], 1), round(r["calm_auc"], 3), round(r["crisis_auc"], 3), r["episodes"], r["missed"]] == [88.4, 67.5, 0.929, 0.962, 13, 0]
    assert round(r["d_unfiltered"], 3) == 0.456 and round(r["d_vol"], 3) == 0.186 and r["error"] is None and (r["scenario"], r["seed"]) == ("base", 19)


def test_published_capacity(published, spark):
    weights, returns = study.capacity_book(published, CONFIG)
    a = study.capacity_assumptions(returns.where(F.col("run_id").endswith("hmm")), 6, 504)
    m = costs.capacity_moments(weights, returns, a, 504).persist()
    aum = spark.createDataFrame([(1e6,), (1e9,)], "aum double")
    got = {(r["run_id"].split("|")[1], r["aum"]): round(r["sharpe"], 2) for r in costs.sharpe_at(m, aum).collect()}
    #: Published net Sharpe ratios, and the capital at which they halve.
    assert got == {("unfiltered", 1e6): 0.67, ("unfiltered", 1e9): 0.35, ("hmm", 1e6): 1.43, ("hmm", 1e9): 0.75}
    half = {(r["run_id"].split("|")[1], r["y_scale"], r["adv_scale"]): r["aum"] for r in costs.half_sharpe_sensitivity(m).collect()}
    assert len(half) == 18 and round(half["unfiltered", 1.0, 1.0] / 1e9, 2) == round(half["hmm", 1.0, 1.0] / 1e9, 2) == 1.11
    assert half["hmm", 1.0, 10.0] > half["hmm", 1.0, 1.0] > half["hmm", 2.0, 1.0]


def test_paths_do_not_touch_one_another(spark):
    both = dgp.paths(spark, [3, 4], ["vol_only"], 420).persist()
    every = {r["seed"]: r for r in study.evaluate_paths(both, SMALL).collect()}
    alone = study.evaluate_paths(both.where("seed = 4"), SMALL).first()
    for name in ("unfiltered", "hmm", "vol", "oracle", "d_zero_cost", "d_full_sample", "accuracy"):
        assert every[4][name] == pytest.approx(alone[name], rel=1e-9), name
    bands = study.band_sweep(both, SMALL, (0.0, 0.3)).persist()
    assert bands.count() == 2 * (2 * 2 + 1)
    free = {r["seed"]: r["sharpe"] for r in bands.where("gate = 'hmm' and band = 0").collect()}
    assert free[3] == pytest.approx(every[3]["hmm"]) and free[4] == pytest.approx(every[4]["hmm"])
    rows = {r["band"]: r for r in study.summarise_bands(bands).collect()}
    assert rows[0.3]["mean_turnover"] < rows[0.0]["mean_turnover"] and rows[0.0]["n"] == 2


def test_failed_paths_are_rows(spark):
    rows = dgp.paths(spark, [1, 2], ["base"], 300)
    broken = rows.withColumn("value", F.when((F.col("table") == "index") & (F.col("seed") == 2) & (F.col("t") == 7), float("nan")).otherwise(F.col("value")))
    got = study.evaluate_paths(broken, SMALL).persist()
    by = {r["seed"]: r for r in got.collect()}
    assert by[1]["error"] is None and by[2]["error"] and by[2]["hmm"] is None
    s = study.summarise(got).first()
    assert (s["n_ok"], s["n_failed"]) == (1, 1) and s["crossed"] + s["below_at_zero"] + s["above_at_max"] == 1


def test_expanding_median_is_the_plain_one(spark):
    import numpy as np

    from latentspark.functions.windows import expanding_median

    x = np.random.default_rng(4).normal(size=101).round(1).tolist()
    x[0] = x[40] = None
    got = expanding_median(series(spark, x), "x", "m", "series_id").toPandas().sort_values("t")["m"].tolist()
    for t in range(1, 101):
        assert got[t] == pytest.approx(np.median([v for v in x[: t + 1] if v is not None]))
    assert got[0] != got[0] or got[0] is None


def test_break_even_of_rows(spark):
    one = lambda g, t: (g, t, 1e-4, 0.0, 1e-6)
    rows = spark.createDataFrame([(1, one(8e-4, 0.5), one(3e-4, 0.1))], "k int, a struct<mg:double,mt:double,vg:double,cov:double,vt:double>, b struct<mg:double,mt:double,vg:double,cov:double,vt:double>")
    got = e.break_even(rows, "a", "b").first()
    assert got["break_even_status"] == "crossed" and got["break_even"] == pytest.approx(12.5, abs=0.05)
