"""Spread and square-root impact costs, and how much capital a book carries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions import checks
from latentspark.functions.windows import DAYS
from latentspark.operators.backtest import trades


@dataclass(frozen=True)
class CostAssumptions:
    """Per instrument half spread (bps), daily volume (dollars) and volatility; ``impact_y`` scales impact. The defaults of a study are illustrative, not calibrated."""

    half_spread_bps: tuple[float, ...]
    adv_usd: tuple[float, ...]
    sigma_daily: tuple[float, ...]
    impact_y: float = 1.0

    def __post_init__(self):
        for name, x, least in (("half_spread_bps", self.half_spread_bps, 0.0), ("adv_usd", self.adv_usd, math.ulp(0.0)), ("sigma_daily", self.sigma_daily, 0.0)):
            checks.scalar(len(x) > 0 and all(math.isfinite(v) and v >= least for v in x), f"{name} must be finite and in range")
        checks.scalar(len(self.half_spread_bps) == len(self.adv_usd) == len(self.sigma_daily), "cost inputs must have equal length")
        checks.scalar(math.isfinite(self.impact_y) and self.impact_y >= 0.0, "impact_y must be finite and >= 0")

    def table(self, spark: SparkSession) -> DataFrame:
        """(asset_idx, half_spread_bps, adv_usd, sigma_daily), a row per instrument."""
        rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(self.half_spread_bps, self.adv_usd, self.sigma_daily, strict=True))]
        return spark.createDataFrame(rows, "asset_idx int, half_spread_bps double, adv_usd double, sigma_daily double")


def trade_cost(dw: DataFrame, aum: float, a: CostAssumptions) -> DataFrame:
    """Adds trade_usd and cost_usd to rows with asset_idx and dw."""
    checks.positive(aum, "aum")
    trade = F.abs("dw") * aum
    cost = F.col("half_spread_bps") / 1e4 * trade + a.impact_y * F.col("sigma_daily") * F.sqrt(trade / F.col("adv_usd")) * trade
    return dw.join(F.broadcast(a.table(dw.sparkSession)), "asset_idx").withColumn("trade_usd", trade).withColumn("cost_usd", cost).drop("half_spread_bps", "adv_usd", "sigma_daily")


def daily_cost_fraction(positions: DataFrame, aum: float, a: CostAssumptions) -> DataFrame:
    """(run_id, t, cost): a day's trading cost over the capital."""
    return trade_cost(trades(positions), aum, a).groupBy("run_id", "t").agg((F.sum("cost_usd") / aum).alias("cost"))


def participation(positions: DataFrame, aum: float, a: CostAssumptions) -> DataFrame:
    """(run_id, t, asset_idx, participation): traded dollars over daily volume."""
    checks.positive(aum, "aum")
    return trades(positions).join(F.broadcast(a.table(positions.sparkSession)), "asset_idx").select("run_id", "t", "asset_idx", (F.col("dw") * aum / F.col("adv_usd")).alias("participation"))


def capacity_moments(positions: DataFrame, returns: DataFrame, a: CostAssumptions, start: int = 0) -> DataFrame:
    """Means and (co)variances per run of gross return, spread cost and impact at
    one dollar. Cost at any capital is spread + sqrt(capital) * impact, so every
    capital's Sharpe follows from one scan."""
    on = [c for c in ("run_id", "t", "asset_idx") if c in returns.columns]
    cost = F.col("half_spread_bps") / 1e4 * F.col("dw")
    impact = a.impact_y * F.col("sigma_daily") * F.pow("dw", F.lit(1.5)) / F.sqrt("adv_usd")
    daily = (
        trades(positions).join(returns.select(*on, "r"), on).join(F.broadcast(a.table(positions.sparkSession)), "asset_idx")
        .groupBy("run_id", "t").agg(F.sum(F.col("prev") * F.col("r")).alias("g"), F.sum(cost).alias("s"), F.sum(impact).alias("i")).where(F.col("t") >= start)
    )
    pairs = ("gg", "ss", "ii", "gs", "gi", "si")
    return daily.groupBy("run_id").agg(*(F.avg(c).alias(f"m_{c}") for c in "gsi"), *(F.covar_pop(p[0], p[1]).alias(f"c_{p}") for p in pairs))


def sharpe_at(moments: DataFrame, aum: DataFrame) -> DataFrame:
    """(run_id, aum, sharpe) for every capital in ``aum`` (one column)."""
    x = F.sqrt("aum")
    mean = F.col("m_g") - F.col("m_s") - x * F.col("m_i")
    var = F.greatest(F.col("c_gg") + F.col("c_ss") + x * x * F.col("c_ii") - 2 * F.col("c_gs") - 2 * x * F.col("c_gi") + 2 * x * F.col("c_si"), F.lit(0.0))
    return moments.crossJoin(F.broadcast(aum)).select("run_id", "aum", F.when(var > 0, math.sqrt(DAYS) * mean / F.sqrt(var)).otherwise(0.0).alias("sharpe"))


def sharpe_function(moments: dict, impact: float = 1.0) -> Callable[[float], float]:
    """The same for one run's collected moments, with impact costs scaled by ``impact``."""

    def sharpe(aum: float) -> float:
        x, m = impact * math.sqrt(aum), moments
        mean = m["m_g"] - m["m_s"] - x * m["m_i"]
        var = m["c_gg"] + m["c_ss"] + x * x * m["c_ii"] - 2 * m["c_gs"] - 2 * x * m["c_gi"] + 2 * x * m["c_si"]
        return math.sqrt(DAYS) * mean / math.sqrt(var) if var > 0 else 0.0

    return sharpe


def half_sharpe_sensitivity(moments: DataFrame, y_scales: tuple[float, ...] = (0.5, 1.0, 2.0), adv_scales: tuple[float, ...] = (0.1, 1.0, 10.0), low: float = 1e6, high: float = 1e11) -> DataFrame:
    """(run_id, y_scale, adv_scale, aum): the capital at which a run's Sharpe halves, with
    impact and daily volumes scaled. Impact goes with y / sqrt(volume), so one
    table of :func:`capacity_moments` serves all; null where there is no such capital."""
    grid = [(y, v) for y in y_scales for v in adv_scales]

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(m["run_id"], y, v, aum_at_sharpe_fraction(sharpe_function(m, y / math.sqrt(v)), 0.5, low, high)) for m in pdf.to_dict("records") for y, v in grid]
            yield pd.DataFrame(rows, columns=["run_id", "y_scale", "adv_scale", "aum"]).astype({"aum": "Float64"})

    return moments.mapInPandas(search, "run_id string, y_scale double, adv_scale double, aum double")


def aum_at_sharpe_fraction(sharpe: Callable[[float], float], fraction: float = 0.5, low: float = 1e6, high: float = 1e12, n_grid: int = 41, tol: float = 1e-4) -> float | None:
    """The capital at which Sharpe falls to ``fraction`` of its value at ``low``: first crossing on a log grid,
    then geometric bisection. None if there is nothing to lose or no crossing."""
    checks.scalar(0.0 < low < high and 0.0 < fraction < 1.0 and n_grid >= 2 and tol > 0.0, "needs 0 < low < high, 0 < fraction < 1, n_grid >= 2, tol > 0")
    base = sharpe(low)
    if not base > 0.0:
        return None
    grid = [low * (high / low) ** (i / (n_grid - 1)) for i in range(n_grid)]
    hit = next((i for i, a in enumerate(grid) if sharpe(a) <= fraction * base), None)
    if hit is None:
        return None
    a, b = grid[max(hit - 1, 0)], grid[hit]
    while b / a - 1.0 > tol:
        mid = math.sqrt(a * b)
        a, b = (a, mid) if sharpe(mid) <= fraction * base else (mid, b)
    return b
