"""Backtest accounting without lookahead: positions of one day earn the next day's return."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions import checks
from latentspark.functions.windows import DAYS, lag_or, over, sofar


def trades(positions: DataFrame) -> DataFrame:
    """(run_id, t, asset_idx, p, prev, dw): what is held, was held, and is traded; nothing is held before day 0."""
    return positions.withColumn("prev", lag_or("p", 0.0, "run_id", "asset_idx")).withColumn("dw", F.abs(F.col("p") - F.col("prev")))


def flows(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """(run_id, t, gross, turnover) from (run_id, t, asset_idx, p) and (t, asset_idx, r), or returns by run_id too."""
    on = [c for c in ("run_id", "t", "asset_idx") if c in returns.columns]
    return (
        trades(positions).join(returns.select(*on, "r"), on)
        .groupBy("run_id", "t")
        .agg(F.sum(F.col("prev") * F.col("r")).alias("gross"), F.sum("dw").alias("turnover"))
    )


def with_equity(daily: DataFrame) -> DataFrame:
    """Adds equity, the running product of 1 + net from the first row on."""
    return daily.withColumn("equity", F.product(1.0 + F.col("net")).over(sofar("run_id")))


def run_backtest(positions: DataFrame, returns: DataFrame, cost_bps: float = 0.0, validate: bool = True) -> DataFrame:
    """(run_id, t, gross, turnover, net, equity) of every run.

    Raises ValueError on non-finite input, returns of -1 or less, a bad cost,
    or a day whose net return wipes the book out (naming the first)."""
    checks.scalar(math.isfinite(cost_bps) and cost_bps >= 0.0, f"cost_bps must be finite and >= 0, got {cost_bps}")
    if validate:
        checks.all_finite(positions, "p", ["run_id", "t", "asset_idx"], "positions")
        checks.returns_domain(returns, "r", ["t", "asset_idx"])
    daily = flows(positions, returns).withColumn("net", F.col("gross") - cost_bps / 1e4 * F.col("turnover"))
    if validate:
        wiped_out(daily)
    return with_equity(daily)


def save_backtest(positions: DataFrame, returns: DataFrame, path: str, cost_bps: float = 0.0) -> DataFrame:
    """:func:`run_backtest` written to ``path``; its rules ride along in the one job that writes, raise the same and leave nothing behind."""
    checks.scalar(math.isfinite(cost_bps) and cost_bps >= 0.0, f"cost_bps must be finite and >= 0, got {cost_bps}")
    p = checks.Watch(positions, ~checks.finite("p"), ["run_id", "t", "asset_idx"], "positions must be finite")
    r = checks.Watch(returns, ~checks.finite("r") | (F.col("r") <= -1.0), ["t", "asset_idx"], "returns must be finite and > -1")
    daily = flows(p.df, r.df).withColumn("net", F.col("gross") - cost_bps / 1e4 * F.col("turnover"))
    w = checks.Watch(daily, F.col("net") <= -1.0, ["t", "run_id"], "net return <= -1 wipes the book out")
    return checks.write_watched(with_equity(w.df), [p, r, w], path)


def wiped_out(daily: DataFrame) -> None:
    checks.first_offender(daily, F.col("net") <= -1.0, ["t", "run_id"], "net return <= -1 wipes the book out")


def drawdown(daily: DataFrame) -> DataFrame:
    """Adds drawdown from the highest equity so far; the first equity is the first peak."""
    return daily.withColumn("drawdown", F.col("equity") / F.max("equity").over(sofar("run_id")) - 1.0)


def max_drawdown(daily: DataFrame) -> DataFrame:
    checks.first_offender(daily, ~checks.finite("equity") | (F.col("equity") <= 0.0), ["t", "run_id"], "equity must be finite and > 0")
    return drawdown(daily).groupBy("run_id").agg(F.min("drawdown").alias("max_dd"))


def worst_period(daily: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(run_id, worst_month): the least compounded return of a calendar month,
    or without ``dates`` (t, date) of a 21-day block. A last block that isn't
    full is left out, unless there is no other."""
    if dates is not None:
        bad = dates.select(F.col("date").isNull() | (F.coalesce(F.lag("date").over(Window.orderBy("t")), F.lit("0001-01-01").cast("date")) >= F.col("date")))
        if not bad.where(bad.columns and F.col(bad.columns[0])).isEmpty():
            raise ValueError("dates must be present and strictly increasing")
        rows = daily.join(dates, "t").withColumn("block", F.trunc("date", "MM").cast("string"))
    else:
        n = F.count("*").over(Window.partitionBy("run_id"))
        k = F.row_number().over(over("run_id")) - 1
        rows = daily.withColumn("block", F.floor(k / 21).cast("string")).withColumn("__in", (n < 21) | (k < F.floor(n / 21) * 21)).where("__in")
    return rows.groupBy("run_id", "block").agg((F.product(1.0 + F.col("net")) - 1.0).alias("m")).groupBy("run_id").agg(F.min("m").alias("worst_month"))


def sharpe_of(mean: Column, sd: Column) -> Column:
    return F.when(sd > 0.0, math.sqrt(DAYS) * mean / sd).otherwise(0.0)


def compute_metrics(daily: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """One row per run: ann_return, ann_vol, sharpe, max_dd, calmar, hit_rate, worst_month from ``net``. Equity starts anew at 1."""
    base = drawdown(with_equity(daily.select("run_id", "t", "net")))
    mean, sd = F.avg("net"), F.stddev_pop("net")
    moments = base.groupBy("run_id").agg(
        (DAYS * mean).alias("ann_return"),
        (math.sqrt(DAYS) * sd).alias("ann_vol"),
        sharpe_of(mean, sd).alias("sharpe"),
        F.min("drawdown").alias("max_dd"),
        F.avg(F.when(F.col("net") > 0.0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    calmar = F.when(F.col("max_dd") != 0.0, F.col("ann_return") / F.abs("max_dd")).otherwise(0.0)
    return moments.withColumn("calmar", calmar).join(worst_period(daily, dates), "run_id").select("run_id", "ann_return", "ann_vol", "sharpe", "max_dd", "calmar", "hit_rate", "worst_month")


def state_conditional_returns(daily: DataFrame, states: DataFrame, n_states: int) -> DataFrame:
    """(run_id, state, n_days, ann_return, ann_vol, sharpe) for every state 0..n_states-1; a state without days has zeros."""
    checks.scalar(n_states >= 1, f"n_states must be >= 1, got {n_states}")
    checks.first_offender(states, F.col("state").isNull() | (F.col("state") < 0) | (F.col("state") >= n_states), ["t"], f"states must be in [0, {n_states})")
    mean, sd = F.avg("net"), F.stddev_pop("net")
    got = daily.join(states.select("t", "state"), "t").groupBy("run_id", "state").agg(
        F.count("*").alias("n_days"), (DAYS * mean).alias("ann_return"), (math.sqrt(DAYS) * sd).alias("ann_vol"), sharpe_of(mean, sd).alias("sharpe")
    )
    grid = daily.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state"))
    zero = {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ann_return", "ann_vol", "sharpe")}
    return grid.join(got, ["run_id", "state"], "left").select("run_id", "state", F.coalesce("n_days", F.lit(0)).alias("n_days"), *zero.values())


def bincount(states: DataFrame, n_states: int) -> DataFrame:
    """(state, n) for every state, zeros included."""
    grid = states.sparkSession.range(n_states).select(F.col("id").cast("int").alias("state"))
    return grid.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
