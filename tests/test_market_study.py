"""The study of a market from local files, on made-up ones, against plain arrays."""

import datetime as dt

import numpy as np
import pytest

from latentspark.operators import hmm, hmm_kernel
from latentspark.plans import market_study as ms
from tests.helpers import column

CFG = {
    "n_states": 2, "em_tol": 1e-6, "em_max_iter": 40, "var_floor": 1e-8, "momentum_lookback": 40, "vol_target": 0.1, "ewma_lambda": 0.94, "leverage_cap": 4.0,
    "train_min_days": 120, "refit_days": 100, "gate_mode": "prob", "gate_threshold": 0.5, "cost_bps": 5.0,
}


def _files(folder, n=400):
    rng = np.random.default_rng(2)
    days = [dt.date(1984, 1, 2) + dt.timedelta(days=i) for i in range(n)]
    calm = (np.arange(n) // 60) % 2 == 0
    mkt = np.where(calm, rng.normal(0.08, 0.5, n), rng.normal(-0.1, 2.0, n)).round(2)
    ind = (mkt[:, None] + rng.normal(0, 0.5, (n, 3))).round(2)
    line = lambda d, v: f"{d:%Y%m%d}, " + ", ".join(f"{x:.2f}" for x in v)
    (folder / "ff.csv").write_text("\n".join(["Title", ",Mkt-RF,SMB,HML,RF", *(line(d, (m, 0.1, 0.2, 0.01)) for d, m in zip(days, mkt, strict=True)), "", "end"]))
    (folder / "ind.csv").write_text("\n".join(["Title", ",A,B,C", *(line(d, v) for d, v in zip(days[3:], ind[3:], strict=True)), "", "20300101, 1, 1, 1"]))
    return days, mkt / 100, ind / 100


def test_study_of_local_files(spark, tmp_path):
    days, mkt, ind = _files(tmp_path)
    market, industries = ms.load_market(spark, f"{tmp_path}/ff.csv", f"{tmp_path}/ind.csv", ["a", "b", "c"], since="1984-01-10")
    keep = [i for i, d in enumerate(days) if d >= dt.date(1984, 1, 10)]
    mkt, ind, days = mkt[keep], ind[keep], [days[i] for i in keep]
    assert column(market, "date") == days and np.allclose(column(market, "excess"), mkt)
    assert np.allclose(industries.orderBy("t", "asset_idx").toPandas()["r"].to_numpy().reshape(-1, 3), ind - 0.0001)
    out = ms.study(market, industries, CFG, n_boot=50)
    metrics = {r["run_id"]: r for r in out["metrics"].collect()}
    assert len(metrics) == 12 and {r["run_id"].split("|")[1] for r in metrics.values()} == {"unfiltered", "hmm", "hmm_band", "constant", "vol", "ewma"}
    # The market book under the model's gate, by hand.
    report = hmm_kernel.walk_forward(mkt + 0.0001, n_states=2, tol=1e-6, max_iter=40, var_floor=1e-8, train_min=120, refit=100, mode="prob", threshold=0.5)
    held = np.concatenate([[0.0], report.gate[:-1]])
    net = held * mkt - 5e-4 * np.abs(np.diff(np.concatenate([[0.0], report.gate])))
    late = net[120:]
    assert metrics["market|hmm"]["sharpe"] == pytest.approx(np.sqrt(252) * late.mean() / late.std(), rel=1e-8)
    level = report.gate[119:-1].mean()
    const = np.where(np.arange(len(mkt)) < 119, 1.0, level)
    assert metrics["market|constant"]["ann_return"] == pytest.approx(252 * (np.concatenate([[0.0], const[:-1]]) * mkt - 5e-4 * np.abs(np.diff(np.concatenate([[0.0], const]))))[120:].mean(), rel=1e-8)
    boot = {r["run_id"]: r for r in out["bootstrap"].collect()}
    assert set(boot) == {f"{b}|{x}-{y}" for b in ("market", "momentum") for x, y in ms.PAIRS}
    assert boot["market|hmm-unfiltered"]["diff"] == pytest.approx(metrics["market|hmm"]["sharpe"] - metrics["market|unfiltered"]["sharpe"], rel=1e-8)
    periods = {(r["run_id"], r["period"]): r for r in out["periods"].collect()}
    first = np.array([d.year <= 1984 for d in days])
    assert periods[("market|hmm", "1965-1984")]["sharpe"] == pytest.approx(np.sqrt(252) * net[first].mean() / net[first].std(), rel=1e-8)
    assert periods[("market|hmm", "1985-2004")]["n_days"] == int((~first).sum()) and ("market|hmm", "2005-end") not in periods


def test_transition_rows(spark):
    x = np.random.default_rng(0).normal(size=60)
    fits = hmm.fit_hmm(spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "series_id string, t int, x double"), (2,), max_iter=5)
    rows = {(r["state"], r["to_state"]): r["p"] for r in hmm.transition_rows(fits).collect()}
    a = np.array(fits.first()["transmat"])
    assert rows == {(i, j): a[i, j] for i in range(2) for j in range(2)}
