"""Exposure gates (series, t, gate) that need no model, and what is done to gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions import checks
from latentspark.functions.windows import expanding_median, ewma_variance, over, rolling_rms
from latentspark.operators import hmm_kernel


def apply_gate_band(gate: DataFrame, band: float, key: str = "series_id") -> DataFrame:
    """No-trade band: what is held moves to the gate only when they differ by more than ``band``; 1 before the first day."""
    checks.scalar(0.0 <= band <= 1.0, f"band must be in [0, 1], got {band}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        return pdf.assign(gate=hmm_kernel.band(pdf["gate"].to_numpy(dtype=float), band))

    rows = gate.select(key, "t", "gate")
    return rows.groupBy(key).applyInPandas(run, rows.schema)


def lag_gate(gate: DataFrame, lag: int, key: str = "series_id") -> DataFrame:
    """The gate ``lag`` days late; its first value before that."""
    checks.scalar(lag >= 0, f"lag must be >= 0, got {lag}")
    w = over(key)
    return gate.select(key, "t", F.coalesce(F.lag("gate", lag).over(w), F.first("gate").over(w)).alias("gate"))


def constant_gate(days: DataFrame, level: float, first_day: int, key: str = "series_id") -> DataFrame:
    checks.scalar(0.0 <= level <= 1.0, f"level must be in [0, 1], got {level}")
    return days.select(key, "t", F.when(F.col("t") < first_day, 1.0).otherwise(float(level)).alias("gate"))


def oracle_gate(states: DataFrame, first_day: int, crisis: int, key: str = "series_id") -> DataFrame:
    """0 on days before a crisis day, from ``first_day`` on; the last day is 1."""
    ahead = F.coalesce(F.lead("state").over(over(key)) == crisis, F.lit(False))
    return states.select(key, "t", F.when(ahead & (F.col("t") >= first_day), 0.0).otherwise(1.0).alias("gate"))


def _ratio_gate(df: DataFrame, vol: str, first_day: int, key: str) -> DataFrame:
    ratio = F.when(F.col(vol) > 0.0, F.least(F.col("mid") / F.col(vol), F.lit(1.0))).otherwise(1.0)
    return expanding_median(df.select(key, "t", vol), vol, "mid", key).select(key, "t", F.when(F.col("t") < first_day, 1.0).otherwise(ratio).alias("gate"))


def vol_ratio_gate(series: DataFrame, first_day: int, window: int = 21, key: str = "series_id") -> DataFrame:
    """min(1, median of the trailing volatilities so far / today's); 1 where that is 0 or undefined, and before ``first_day``."""
    checks.scalar(window >= 1, f"window must be >= 1, got {window}")
    return _ratio_gate(series.select(key, "t", rolling_rms("x", window, key).alias("vol")), "vol", first_day, key)


def ewma_ratio_gate(series: DataFrame, first_day: int, lam: float = 0.94, init_window: int = 21, key: str = "series_id") -> DataFrame:
    """The same with exponentially weighted volatility."""
    rows = ewma_variance(series.select(key, "t", "x"), "x", lam, init_window, "var", key).withColumn("vol", F.sqrt("var"))
    return _ratio_gate(rows, "vol", first_day, key)


def crisis_episodes(states: DataFrame, start: int, crisis: int, key: str = "series_id") -> DataFrame:
    """(series, first_t, end_t): runs of crisis days that begin on ``start`` or later; the end is exclusive."""
    hit = states.where(F.col("state") == crisis)
    run = F.col("t") - F.row_number().over(Window.partitionBy(key).orderBy("t"))
    return hit.withColumn("run", run).groupBy(key, "run").agg(F.min("t").alias("first_t"), (F.max("t") + 1).alias("end_t")).where(F.col("first_t") >= start).drop("run")
