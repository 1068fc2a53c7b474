"""Positions of two sleeves, and what scales or gates them. Panels are long: (t, asset_idx, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions import checks
from latentspark.functions.windows import DAYS, capped_leverage, ewma_variance, lag_or, trailing_return
from latentspark.operators.backtest import flows


def _day_count(df: DataFrame) -> int:
    return df.agg((F.max("t") + 1).alias("n")).first()["n"] or 0


def momentum_positions(returns: DataFrame, lookback: int = 252, vol_target: float = 0.10, ewma_lambda: float = 0.94, leverage_cap: float = 4.0, validate: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, asset_idx, p): sign of the trailing return times capped leverage, over the number of assets; 0 until the first full window."""
    checks.scalar(lookback >= 1, f"lookback must be >= 1, got {lookback}")
    checks.positive(vol_target, "vol_target")
    checks.positive(leverage_cap, "leverage_cap")
    if validate:
        checks.returns_domain(returns, "r", ["t", "asset_idx"])
        checks.scalar(_day_count(returns) > lookback, "needs more days than the lookback")
    assets = returns.groupBy(*keys).agg(F.countDistinct("asset_idx").cast("double").alias("n_assets"))
    rows = ewma_variance(returns.select(*keys, "t", "asset_idx", "r"), "r", ewma_lambda, lookback, "var", *keys, "asset_idx")
    rows = rows.withColumn("trend", trailing_return("r", lookback, *keys, "asset_idx"))
    rows = rows.join(assets, list(keys)) if keys else rows.crossJoin(F.broadcast(assets))  # without keys one row
    p = F.signum("trend") * capped_leverage(F.col("var"), vol_target, leverage_cap) / F.col("n_assets")
    return rows.select(*keys, "t", "asset_idx", F.coalesce(p, F.lit(0.0)).alias("p"))


def carry_positions(diffs: DataFrame, top_n: int = 3, bottom_n: int = 3, rebalance_days: int = 21, validate: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, asset_idx, p) from rate differentials (keys, t, asset_idx, diff): every
    ``rebalance_days`` the highest ``top_n`` share +1 and the lowest ``bottom_n``
    share -1, ties going to the lower asset; held in between."""
    checks.scalar(top_n >= 1 and bottom_n >= 1 and rebalance_days >= 1, "top_n, bottom_n and rebalance_days must be >= 1")
    if validate:
        checks.all_finite(diffs, "diff", ["t", "asset_idx"], "rate differentials")
        n = diffs.agg(F.countDistinct("asset_idx")).first()[0]
        checks.scalar(top_n + bottom_n <= n, f"top_n + bottom_n must be <= {n}")
    day = Window.partitionBy(*keys, "t").orderBy(F.col("diff").desc(), "asset_idx")
    size = F.count("*").over(Window.partitionBy(*keys, "t"))
    ranked = diffs.where(F.col("t") % rebalance_days == 0).withColumn("k", F.row_number().over(day)).withColumn("n", size)
    held = F.when(F.col("k") <= top_n, 1.0 / top_n).when(F.col("k") > F.col("n") - bottom_n, -1.0 / bottom_n).otherwise(0.0)
    ranked = ranked.select(*keys, F.col("t").alias("t0"), "asset_idx", held.alias("p"))
    return diffs.withColumn("t0", F.col("t") - F.col("t") % rebalance_days).join(ranked, [*keys, "t0", "asset_idx"]).select(*keys, "t", "asset_idx", "p")


def carry_total_returns(spot: DataFrame, diffs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, asset_idx, r): spot return plus a day's accrual of the previous day's differential; day 0 accrues nothing."""
    accrual = diffs.select(*keys, "t", "asset_idx", (lag_or("diff", 0.0, *keys, "asset_idx") / DAYS).alias("a"))
    return spot.join(accrual, [*keys, "t", "asset_idx"]).select(*keys, "t", "asset_idx", (F.col("r") + F.col("a")).alias("r"))


def portfolio_scale(daily: DataFrame, target: float = 0.10, lam: float = 0.94, cap: float = 4.0, first_day: int = 0, window: int = 21) -> DataFrame:
    """(run_id, t, scale): 1 until ``window`` net returns from ``first_day`` are known, then target over their exponential volatility, capped."""
    checks.positive(target, "target")
    checks.positive(cap, "cap")
    checks.scalar(first_day >= 0, f"first_day must be >= 0, got {first_day}")
    rows = ewma_variance(daily.select("run_id", "t", "net"), "net", lam, window, "var", "run_id", first_day=first_day)
    return rows.select("run_id", "t", F.coalesce(capped_leverage(F.col("var"), target, cap), F.lit(1.0)).alias("scale"))


def apply_gate(positions: DataFrame, gate: DataFrame, validate: bool = False) -> DataFrame:
    """Positions times the day's gate; ``gate`` is (t, gate), or by run_id too."""
    if validate:
        checks.all_finite(positions, "p", ["t", "asset_idx"], "positions")
        checks.all_finite(gate, "gate", ["t"], "gate")
    on = [c for c in ("run_id", "t") if c in gate.columns and c in positions.columns]
    return positions.join(gate.select(*on, "gate"), on).withColumn("p", F.col("p") * F.col("gate")).drop("gate")


def scaled_book(trend: DataFrame, spot: DataFrame, diffs: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, returns, scale) of both sleeves, run_id 'momentum' and 'carry'.

    The scale comes from the raw 50/50 book at the configured cost and multiplies
    both sleeves; no gate takes part in it."""
    sleeve = lambda df, name: df.withColumn("run_id", F.lit(name))
    momentum = sleeve(momentum_positions(trend, cfg["momentum_lookback"], cfg["vol_target"], cfg["ewma_lambda"], cfg["leverage_cap"], validate=False), "momentum")
    carry = sleeve(carry_positions(diffs, cfg["carry_top_n"], cfg["carry_bottom_n"], cfg["rebalance_days"], validate=False), "carry")
    raw = momentum.unionByName(carry)
    returns = sleeve(trend.select("t", "asset_idx", "r"), "momentum").unionByName(sleeve(carry_total_returns(spot, diffs), "carry"))
    net = flows(raw, returns).withColumn("net", F.col("gross") - cfg["cost_bps"] / 1e4 * F.col("turnover"))
    scale = portfolio_scale(combined(net, "book"), cfg["portfolio_vol_target"], cfg["ewma_lambda"], cfg["leverage_cap"], cfg["momentum_lookback"])
    positions = raw.join(scale.select("t", "scale"), "t").select("run_id", "t", "asset_idx", (F.col("p") * F.col("scale")).alias("p"))
    return positions, returns, scale


def combined(daily: DataFrame, run_id: str, value: str = "net") -> DataFrame:
    """The 50/50 book of all runs in ``daily``: half the sum of their daily values."""
    return daily.groupBy("t").agg((0.5 * F.sum(value)).alias(value)).select(F.lit(run_id).alias("run_id"), "t", value)


def winsorize_mad(df: DataFrame, x: str, width: float = 8.0, *keys: str) -> DataFrame:
    """``x`` clipped to median +- width * 1.4826 * MAD of its series; unchanged where the MAD is 0."""
    mid = df.groupBy(*keys).agg(F.percentile(F.col(x), F.lit(0.5)).alias("__m"))
    rows = df.join(F.broadcast(mid), list(keys)) if keys else df.crossJoin(F.broadcast(mid))
    spread = rows.groupBy(*keys).agg(F.percentile(F.abs(F.col(x) - F.col("__m")), F.lit(0.5)).alias("__s"))
    rows = rows.join(F.broadcast(spread), list(keys)) if keys else rows.crossJoin(F.broadcast(spread))
    reach = width * 1.4826 * F.col("__s")
    clipped = F.least(F.greatest(F.col(x), F.col("__m") - reach), F.col("__m") + reach)
    return rows.withColumn(x, F.when(F.col("__s") > 0, clipped).otherwise(F.col(x))).drop("__m", "__s")
