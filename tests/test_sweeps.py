"""Sweeps and resampling against their plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.operators import evaluation as e
from latentspark.operators import gates
from latentspark.sources import dataset, dgp
from tests.helpers import column, panel, series, states


def _stream(spark, n=300):
    rng = np.random.default_rng(28)
    g, t = rng.normal(5e-4, 0.01, n), np.abs(rng.normal(0.1, 0.05, n))
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(g, t, strict=True))]
    return spark.createDataFrame(rows, "run_id string, t int, gross double, turnover double"), g, t


def test_cost_sweep_is_the_plain_sharpe(spark):
    s, g, t = _stream(spark)
    for r in e.cost_sweep(s, [0, 5, 20], 100).collect():
        net = (g - r["cost_bps"] / 1e4 * t)[100:]
        assert r["sharpe"] == pytest.approx(math.sqrt(252) * net.mean() / net.std(), rel=1e-9)


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(1e-3, 0.01, 200)
    rows = [("same", i, float(x), float(x)) for i, x in enumerate(a)] + [("better", i, float(x) + 0.002, float(x)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "run_id string, t int, a double, b double")
    got = {r["run_id"]: r for r in e.paired_block_bootstrap(df, 600, 10.0).collect()}
    assert got["same"]["low"] == got["same"]["high"] == got["same"]["std_error"] == 0.0
    assert got["better"]["low"] > 0 and got["better"]["p_positive"] == 1.0 and got["better"]["n_boot"] == 600
    again = {r["run_id"]: r for r in e.paired_block_bootstrap(df.repartition(3), 600, 10.0).collect()}
    assert again["better"]["low"] == pytest.approx(got["better"]["low"], abs=1e-12)
    # One replicate, the plain way.
    idx = e.stationary_bootstrap_indices(200, 600, 10.0, 83)
    sh = lambda v: math.sqrt(252) * v.mean(axis=1) / v.std(axis=1)
    d = sh(a[idx] + 0.002) - sh(a[idx])
    assert got["better"]["low"] == pytest.approx(np.percentile(d, 2.5), rel=1e-9) and got["better"]["std_error"] == pytest.approx(d.std(ddof=1), rel=1e-9)


def test_mean_block_length():
    lengths = np.concatenate([e.stationary_bootstrap_blocks(5000, 21.0, 7, r)[1] for r in range(40)])
    starts = np.concatenate([e.stationary_bootstrap_blocks(5000, 21.0, 7, r)[0] for r in range(40)])
    assert 19 < lengths.mean() < 23 and 2300 < starts.mean() < 2700 and starts.min() >= 0 and starts.max() < 5000


@pytest.mark.parametrize(("n", "mean_block"), [(1, 1.0), (7, 1.0), (200, 10.0), (30, 500.0)])
def test_block_rows_are_the_plain_draws(spark, n, mean_block):
    rows = e.bootstrap_block_rows(spark.createDataFrame([("r", n, b) for b in range(50)], "run_id string, n long, replicate int"), mean_block, 83).collect()
    for b in range(50):
        start, length = e.stationary_bootstrap_blocks(n, mean_block, 83, b)
        assert sorted((r["start"], r["stop"]) for r in rows if r["replicate"] == b) == sorted(zip(start.tolist(), (start + length).tolist(), strict=True))
        assert length.sum() == n


def test_lag_sweep_matches_one_lag(spark):
    rng = np.random.default_rng(1)
    one = lambda v, name: panel(spark, v, name, "momentum")
    p, r = one(rng.normal(size=(60, 2)), "p"), one(rng.normal(size=(60, 2)) * 0.01, "r")
    g = series(spark, rng.uniform(size=60), "gate", "g")
    got = {x["lag"]: x["sharpe"] for x in e.lag_sweep(p, r, g, [0, 3], 5.0).collect()}
    late = e.sharpe(e.net(e.build_book(p, r, gates.lag_gate(g, 3)), 5.0)).first()["sharpe"]
    assert got[3] == pytest.approx(late) and got[0] != got[3]


def test_classification(spark):
    s = [0, 0, 2, 2, 2, 0, 1, 0, 2, 0, 0, 1]
    g = [0.9, 0.8, 0.7, 0.2, 0.1, 0.9, 0.4, 0.9, 0.8, 0.9, 0.3, 0.2]
    r = e.classification_report(states(spark, s), series(spark, g, "gate"), 0).first()
    calm, said = np.array(s) == 0, np.array(g) >= 0.5
    assert r["accuracy"] == pytest.approx((calm == said).mean()) and r["majority_accuracy"] == pytest.approx(max(calm.mean(), 1 - calm.mean()))
    assert (r["episodes"], r["missed"], r["median_lag"]) == (2, 1, 1.0)


def test_ratio_gates_ignore_the_future(spark):
    x = np.random.default_rng(6).normal(0, 0.01, 120)
    y = x.copy()
    y[80:] *= 9
    for make in (lambda s: gates.vol_ratio_gate(s, 30), lambda s: gates.ewma_ratio_gate(s, 30)):
        assert np.allclose(column(make(series(spark, x)), "gate")[:80], column(make(series(spark, y)), "gate")[:80])


def test_seed_rule_and_summary(spark):
    sh = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.3), (4, 0.3)], "seed int, sharpe double")
    assert dgp.select_seed(sh).first()["seed"] == 3
    rows = [("base", 1.0, 0.5, None), ("base", 0.2, 0.5, None), ("base", None, None, "failed")]
    got = e.summarise_paths(spark.createDataFrame(rows, "scenario string, gate double, plain double, error string"), ("gate", "plain")).first()
    assert (got["n_ok"], got["n_failed"], got["wins_gate_plain"], got["mean_gate"]) == (2, 1, 1, pytest.approx(0.6))


def test_scenarios():
    base, half, flat, fat = (dgp.simulate(3, s, 300) for s in dgp.SCENARIOS)
    assert (base["states"] == half["states"]).all() and (base["states"] == flat["states"]).all()
    assert not np.allclose(base["index"], half["index"]) or (base["states"] != 2).all()
    assert fat["index"].std() > 0
    with pytest.raises(ValueError):
        dgp.simulate(1, "none", 10)


def test_dataset_round_trip(spark, tmp_path):
    import json
    import os

    cfg = {k: 3 for k in dataset.INT_KEYS} | {k: 0.5 for k in dataset.FLOAT_KEYS} | {"gate_mode": "prob"}
    ds = dgp.dataset(spark, cfg, 5, days=40)
    dataset.write_dataset(ds, f"{tmp_path}/out")
    os.makedirs(tmp_path / "in")
    for n in ("market_index", "trend_assets", "fx_carry", "true_states"):
        part = next(p for p in (tmp_path / "out" / f"{n}.csv").iterdir() if p.suffix == ".csv")
        (tmp_path / "in" / f"{n}.csv").write_text(part.read_text())
    whole = dataset.load_dataset(spark, f"{tmp_path}/out")  # folders read as well as files
    assert whole.config == dataset.validate_config(cfg) and column(whole.states, "state") == column(ds.states, "state")
    (tmp_path / "in" / "config.json").write_text(json.dumps(cfg))
    back = dataset.load_dataset(spark, f"{tmp_path}/in")
    assert np.allclose(column(back.index, "x"), column(ds.index, "x"), atol=1e-10)
    assert np.allclose(back.trend.orderBy("t", "asset_idx").toPandas()["r"], ds.trend.orderBy("t", "asset_idx").toPandas()["r"], atol=1e-9)
    text = (tmp_path / "in" / "true_states.csv").read_text().splitlines()
    (tmp_path / "in" / "true_states.csv").write_text("\n".join(text[:-1]))
    with pytest.raises(ValueError, match="dates"):
        dataset.load_dataset(spark, f"{tmp_path}/in")


def test_dated_text_cut_into_many_splits(spark, tmp_path):
    """The first block of rows is taken whole and alone wherever the file is cut."""
    days = [f"{20200101 + 100 * (i // 28) + i % 28}, {i}.0, 0.5" for i in range(280)]
    f = tmp_path / "long.txt"
    f.write_text("\n".join(["Some heading", ",Mkt,RF", *days, "", "Annual", "20301231, 5, 5"]) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    try:
        assert spark.read.text(str(f)).rdd.getNumPartitions() > 5
        got = dataset.read_dated_text(spark, str(f), ["mkt", "rf"]).toPandas().sort_values("date")
    finally:
        spark.conf.set(name, before)
    assert np.allclose(got["mkt"], np.arange(280) / 100.0)


def test_dated_text(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("Heading\n,Mkt,RF\n20200102, 1.50, 0.01\n20200103, -2.00, 0.01\n\nAnnual\n20200101, 9, 9\n")
    got = dataset.read_dated_text(spark, str(f), ["mkt", "rf"]).toPandas()
    assert len(got) == 2 and np.allclose(got["mkt"], [0.015, -0.02])
    f.write_text("20200102, -99.99, 0.01\n")
    with pytest.raises(ValueError, match="missing"):
        dataset.read_dated_text(spark, str(f), ["mkt", "rf"])


def test_markdown(spark):
    assert dataset.to_markdown(spark.createDataFrame([("a", 1.234)], "k string, v double")) == "| k | v |\n|---|---|\n| a | 1.23 |"


def test_percentile_of(spark):
    assert e.percentile_of(series(spark, [1, 2, 3, 4]), "x", 2.0).first()["share"] == 0.5
    assert e.annual_turnover(_stream(spark)[0].withColumn("turnover", F.lit(0.5))).first()["annual_turnover"] == 126.0
