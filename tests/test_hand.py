"""Small panels against the definitions, written out as plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.operators import backtest, costs, evaluation, gates, hmm_kernel, strategies
from latentspark.sources import dataset
from tests.helpers import column, matrix, panel, series, states


HELD = np.array([[0.4, -0.2, 0.0], [0.4, 0.1, 0.3], [0.0, 0.1, -0.3], [0.2, 0.2, 0.2], [0.0, 0.0, 0.0]])
MOVES = np.array([[0.05, 0.01, -0.02], [0.01, -0.03, 0.04], [-0.02, 0.02, 0.01], [0.03, 0.0, -0.01], [-0.01, 0.02, 0.05]])


def _book(p, r, bps):
    """gross, turnover and net of each day: yesterday's positions earn today's returns, today's change is paid for."""
    before, rows = np.zeros(p.shape[1]), []
    for held, moved in zip(p, r, strict=True):
        gross, turnover = float(before @ moved), float(np.abs(held - before).sum())
        rows.append((gross, turnover, gross - bps / 1e4 * turnover))
        before = held
    return np.array(rows).T


def test_backtest(spark):
    d = backtest.run_backtest(panel(spark, HELD, "p", "run"), panel(spark, MOVES), 40.0)
    gross, turnover, net = _book(HELD, MOVES, 40.0)
    assert gross[1] == pytest.approx(0.4 * 0.01 + 0.2 * 0.03) and turnover[1] == pytest.approx(0.6)
    equity = np.cumprod(1 + net)
    for name, want in (("gross", gross), ("turnover", turnover), ("net", net), ("equity", equity)):
        assert np.allclose(column(d, name), want), name
    m = backtest.compute_metrics(d).first()
    fall = min(e / max(equity[: t + 1]) - 1 for t, e in enumerate(equity))
    year, spread = 252 * net.mean(), math.sqrt(252) * net.std()
    want = {"ann_return": year, "ann_vol": spread, "sharpe": year / spread, "max_dd": fall, "hit_rate": (net > 0).mean(), "calmar": year / -fall, "worst_month": equity[-1] - 1}
    for k, v in want.items():
        assert m[k] == pytest.approx(v), k


def test_positions_earn_the_next_day(spark):
    p, r = np.array([[0.0, 0.0], [2.0, 0.0], [0.0, -1.0], [0.0, 0.0]]), np.array([[9.0, 9.0], [9.0, 9.0], [0.3, 9.0], [9.0, 0.2]])
    assert np.allclose(column(backtest.run_backtest(panel(spark, p, "p", "r"), panel(spark, r)), "gross"), [0, 0, 0.6, -0.2])


def test_wipe_out_names_the_first_day(spark):
    with pytest.raises(ValueError, match="t=2"):
        backtest.run_backtest(panel(spark, [[2.5], [2.5], [2.5], [0]], "p", "r"), panel(spark, [[0], [0.1], [-0.45], [0.2]]))


def test_bad_inputs_are_refused(spark):
    p = panel(spark, [[1], [1]], "p", "r")
    with pytest.raises(ValueError, match="> -1"):
        backtest.run_backtest(p, panel(spark, [[0], [-1.0]]))
    with pytest.raises(ValueError, match="finite"):
        backtest.run_backtest(p, panel(spark, [[0], [math.nan]]))
    with pytest.raises(ValueError, match="cost_bps"):
        backtest.run_backtest(p, panel(spark, [[0], [0.0]]), -1.0)


def test_momentum(spark):
    r, lookback, target, lam, cap = np.random.default_rng(12).normal(0, 0.02, (9, 3)), 3, 0.15, 0.7, 0.9
    want = np.zeros_like(r)
    for a in range(3):
        for t in range(lookback - 1, 9):
            square = np.mean(r[:lookback, a] ** 2)
            for u in range(lookback, t + 1):
                square = lam * square + (1 - lam) * r[u, a] ** 2
            trend = math.prod(1 + x for x in r[t - lookback + 1 : t + 1, a]) - 1
            want[t, a] = math.copysign(min(cap, target / math.sqrt(252 * square)), trend) / 3
    assert np.allclose(matrix(strategies.momentum_positions(panel(spark, r), lookback, target, lam, cap)), want)


def test_carry(spark):
    rng = np.random.default_rng(13)
    d, s = rng.integers(-2, 3, (7, 5)) / 40, rng.normal(0, 0.01, (7, 5))  # with ties
    want = np.zeros_like(d)
    for t in range(7):
        best = sorted(range(5), key=lambda a: (-d[t - t % 3, a], a))
        want[t, best[:2]], want[t, best[-1:]] = 0.5, -1.0
    diffs = panel(spark, d, "diff")
    assert np.allclose(matrix(strategies.carry_positions(diffs, 2, 1, 3)), want)
    total = matrix(strategies.carry_total_returns(panel(spark, s), diffs), "r")
    assert np.allclose(total, s + np.vstack([np.zeros(5), d[:-1]]) / 252)
    with pytest.raises(ValueError, match="top_n"):
        strategies.carry_positions(diffs, 3, 3, 1)


#: The published re-rank case, its panel and its metrics.
def test_rerank_panel(spark):
    p = strategies.carry_positions(dataset.rerank_panel(spark, 63, [0, 10, 42], [[0.04, 0.03, 0.02, 0.01], [0.01, 0.02, 0.03, 0.04], [0.02] * 4]), 1, 1, 21)
    held = matrix(p)
    assert (held[15, 0], held[15, 3], held[21, 0], held[21, 3], held[42, 0], held[42, 3]) == (1, -1, -1, 1, 1, -1)
    zero = p.select("t", "asset_idx", F.lit(0.0).alias("r"))
    diffs = dataset.rerank_panel(spark, 63, [0, 10, 42], [[0.04, 0.03, 0.02, 0.01], [0.01, 0.02, 0.03, 0.04], [0.02] * 4])
    d = backtest.run_backtest(p.withColumn("run_id", F.lit("c")), strategies.carry_total_returns(zero, diffs), 5.0)
    m = backtest.compute_metrics(d).first()
    assert m["ann_return"] == pytest.approx(-0.010476190476190476, abs=1e-8)
    assert m["sharpe"] == pytest.approx(-1.700683986300499, abs=1e-8)
    assert m["max_dd"] == pytest.approx(-0.003306364932108563, abs=1e-8)
    with pytest.raises(ValueError):
        dataset.rerank_panel(spark, 10, [1], [[0.0]])


@pytest.mark.parametrize(("seed", "band"), [(1, 0.3), (2, 0.1), (3, 0.0), (4, 1.0)])
def test_band(spark, seed, band):
    gate, held, want = np.random.default_rng(seed).random(25).round(2), 1.0, []
    for g in gate:
        held = g if abs(g - held) > band else held
        want.append(held)
    assert np.allclose(column(gates.apply_gate_band(series(spark, gate, "gate"), band), "gate"), want)


def test_simple_gates(spark):
    r = np.random.default_rng(14).normal(0, 0.01, 12)
    rms = [math.sqrt(np.mean(r[t - 2 : t + 1] ** 2)) for t in range(2, 12)]
    want = [1.0] * 4 + [min(1.0, np.median(rms[: t - 1]) / rms[t - 2]) for t in range(4, 12)]
    assert np.allclose(column(gates.vol_ratio_gate(series(spark, r), 4, 3), "gate"), want)
    found = np.random.default_rng(15).integers(0, 3, 20)
    want = [1.0 if t < 3 or t == 19 or found[t + 1] != 2 else 0.0 for t in range(20)]
    assert column(gates.oracle_gate(states(spark, found), 3, 2), "gate")[:19] == want[:19]
    g = np.random.default_rng(16).random(6)
    assert np.allclose(column(gates.lag_gate(series(spark, g, "gate"), 3), "gate"), [g[0], g[0], g[0], *g[:3]])
    assert column(gates.constant_gate(series(spark, [0] * 5), 0.7, 2), "gate") == [1, 1, 0.7, 0.7, 0.7]
    got = gates.crisis_episodes(states(spark, [0, 2, 2, 1, 2, 0, 0, 2, 2, 2]), 2, 2).toPandas().sort_values("first_t")
    assert got[["first_t", "end_t"]].values.tolist() == [[4, 5], [7, 10]]


def test_block_and_month(spark):
    x = np.random.default_rng(18).normal(0, 0.02, 50)
    d = series(spark, x, "net", "run").withColumnRenamed("series_id", "run_id")
    want = min(np.prod(1 + x[k : k + 21]) - 1 for k in (0, 21))  # the eight days left over are no block
    assert backtest.worst_period(d).first()["worst_month"] == pytest.approx(want)
    d = series(spark, [0.02, -0.03, 0.01, -0.015], "net", "run").withColumnRenamed("series_id", "run_id")
    dates = spark.createDataFrame([(0, "2021-03-30"), (1, "2021-03-31"), (2, "2021-04-01"), (3, "2021-05-03")], "t int, s string").select("t", F.to_date("s").alias("date"))
    assert backtest.worst_period(d, dates).first()["worst_month"] == pytest.approx(min(1.02 * 0.97 - 1, 0.01, -0.015))
    with pytest.raises(ValueError, match="increasing"):
        backtest.worst_period(d, dates.withColumn("date", F.lit("2021-03-30").cast("date")))


def test_costs(spark):
    spread, volume, sigma, y, aum = (3.0, 5.0), (4e8, 9e8), (0.02, 0.015), 0.8, 5e7
    a = costs.CostAssumptions(spread, volume, sigma, y)
    dw = [(0, 0.2), (1, -0.45), (1, 0.0)]
    got = {(r["asset_idx"], r["dw"]): r["cost_usd"] for r in costs.trade_cost(spark.createDataFrame(dw, "asset_idx int, dw double"), aum, a).collect()}
    for i, w in dw:
        usd = abs(w) * aum
        assert got[i, w] == pytest.approx(usd * (spread[i] / 1e4 + y * sigma[i] * math.sqrt(usd / volume[i])))
    p = costs.participation(panel(spark, HELD[:, :2], "p", "r"), aum, a).orderBy("t", "asset_idx").toPandas()
    changed = np.abs(np.diff(HELD[:, :2], axis=0, prepend=np.zeros((1, 2))))
    assert np.allclose(p["participation"], (changed * aum / volume).ravel())
    with pytest.raises(ValueError):
        costs.CostAssumptions((1.0,), (0.0,), (0.1,))


def test_spread_only_costs_tie_to_the_backtest(spark):
    rng = np.random.default_rng(5)
    p, r = panel(spark, rng.normal(size=(30, 3)), "p", "r"), panel(spark, rng.normal(size=(30, 3)) * 0.01)
    a = costs.CostAssumptions((7.0,) * 3, (1e9,) * 3, (0.01,) * 3, 0.0)
    got = column(costs.daily_cost_fraction(p, 1e8, a), "cost")
    d = backtest.run_backtest(p, r, 7.0).toPandas().sort_values("t")
    assert np.allclose(got, d["gross"] - d["net"])
    m = costs.capacity_moments(p, r, a)
    aum = spark.createDataFrame([(1e8,)], "aum double")
    assert costs.sharpe_at(m, aum).first()["sharpe"] == pytest.approx(backtest.compute_metrics(backtest.run_backtest(p, r, 7.0)).first()["sharpe"])
    assert costs.sharpe_function(m.first().asDict())(1e8) == pytest.approx(costs.sharpe_at(m, aum).first()["sharpe"])


def test_aum_search():
    f = lambda aum: 2.0 - math.log10(aum / 1e6)
    assert costs.aum_at_sharpe_fraction(f, 0.5) == pytest.approx(1e7, rel=2e-4)
    assert costs.aum_at_sharpe_fraction(lambda a: -1.0) is None
    assert costs.aum_at_sharpe_fraction(lambda a: 1.0) is None


def test_auc_and_wilson(spark):
    rows = lambda y, s: spark.createDataFrame(list(zip(y, s, strict=True)), "label int, score double")
    auc = lambda y, s: evaluation.roc_auc(rows(y, s)).first()["auc"]
    assert auc([0, 0, 1, 1], [1.0, 2.0, 3.0, 4.0]) == 1.0
    assert auc([1, 1, 0, 0], [1.0, 2.0, 3.0, 4.0]) == 0.0
    assert auc([0, 1, 0, 1], [1.0] * 4) == 0.5
    assert math.isnan(auc([1, 1], [1.0, 2.0]))
    low, high = evaluation.wilson(F.lit(50.0), F.lit(100.0))
    got = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (got["a"], got["b"]) == (pytest.approx(0.4038, abs=1e-3), pytest.approx(0.5962, abs=1e-3))


def test_break_even():
    b = evaluation.break_even_cost(lambda c: 3.0 - c)
    assert (b.status, b.cost_bps) == ("crossed", pytest.approx(3.0, abs=1e-4))
    assert evaluation.break_even_cost(lambda c: -1.0).status == "below_at_zero"
    assert evaluation.break_even_cost(lambda c: 1.0).status == "above_at_max"


def test_winsorize(spark):
    x = np.r_[np.random.default_rng(17).normal(3, 1, 21), 40.0, -25.0]
    mid = np.median(x)
    reach = 3.5 * 1.4826 * np.median(np.abs(x - mid))
    want = np.clip(x, mid - reach, mid + reach)
    assert (want != x).sum() >= 2
    assert np.allclose(column(strategies.winsorize_mad(series(spark, x), "x", 3.5), "x"), want) and np.allclose(hmm_kernel.winsorize(x, 3.5), want)
    assert column(strategies.winsorize_mad(series(spark, [4, 4, 4, -7]), "x", 2.0), "x") == [4, 4, 4, -7]


def test_ewma_blocks_agree_with_the_recurrence(spark):
    from latentspark.functions.windows import ewma_variance

    x = np.random.default_rng(0).normal(size=700)
    want, v = [None] * 19, float(np.mean(x[:20] ** 2))
    want.append(v)
    for y in x[20:]:
        v = 0.5 * v + 0.5 * y * y
        want.append(v)
    got = column(ewma_variance(series(spark, x), "x", 0.5, 20, "v", "series_id"), "v")  # blocks of 331 days
    assert got[:19] == [None] * 19 or all(math.isnan(g) for g in got[:19])
    assert np.allclose(np.array(got[19:], dtype=float), np.array(want[19:], dtype=float), rtol=1e-12)


def test_state_attribution_has_empty_states(spark):
    d = series(spark, [0.01, -0.01, 0.02], "net", "run").withColumnRenamed("series_id", "run_id")
    got = backtest.state_conditional_returns(d, states(spark, [0, 2, 0]), 3).toPandas().sort_values("state")
    assert got["n_days"].tolist() == [2, 0, 1] and got["sharpe"].tolist()[1] == 0.0
    with pytest.raises(ValueError):
        backtest.state_conditional_returns(d, states(spark, [0, 3, 0]), 3)


def test_config_is_strict():
    good = {k: 3 for k in dataset.INT_KEYS} | {k: 0.5 for k in dataset.FLOAT_KEYS} | {"gate_mode": "prob"}
    assert dataset.validate_config(good)["calm_guard"] == 0.0
    for k, v in (("n_states", 3.0), ("n_states", True), ("em_tol", math.nan), ("gate_mode", 1)):
        with pytest.raises(ValueError):
            dataset.validate_config(good | {k: v})
    with pytest.raises(ValueError):
        dataset.validate_config({k: v for k, v in good.items() if k != "cost_bps"})
