"""Ordered per-series columns: trailing windows, exponential averages, runs.

All of them read long tables with an explicit key and an integer day ``t``, and
are windows partitioned by that key: one shuffle serves a chain of them.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

DAYS = 252.0


def over(*keys: str):
    """The window of a series in day order."""
    return Window.partitionBy(*keys).orderBy("t")


def sofar(*keys: str):
    return over(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(n: int, *keys: str):
    return over(*keys).rowsBetween(-(n - 1), Window.currentRow)


def lag_or(col: str | Column, default: float, *keys: str, n: int = 1) -> Column:
    """The value ``n`` days before, ``default`` where there is none."""
    return F.coalesce(F.lag(col, n).over(over(*keys)), F.lit(default))


def trailing_return(r: str, n: int, *keys: str) -> Column:
    """Compounded return of the last ``n`` days; null before day ``n - 1``."""
    return F.when(F.col("t") >= n - 1, F.product(1.0 + F.col(r)).over(trailing(n, *keys)) - 1.0)


def rolling_rms(r: str, n: int, *keys: str) -> Column:
    """Root mean square of the last ``n`` days; null before day ``n - 1``."""
    return F.when(F.col("t") >= n - 1, F.sqrt(F.avg(F.col(r) * F.col(r)).over(trailing(n, *keys))))


def expanding_median(df: DataFrame, x: str, out: str, *keys: str) -> DataFrame:
    """Adds ``out``: the median of all values of the series up to the day; nulls are
    skipped, and null where there is none yet. A series is walked once with
    two heaps, so its time is about that of a sort."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        low, high, medians = [], [], []  # the lower half negated
        for v in pdf[x].tolist():
            if v is not None and v == v:
                heapq.heappush(high, -heapq.heappushpop(low, -v))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
            medians.append(None if not low else -low[0] if len(low) > len(high) else 0.5 * (high[0] - low[0]))
        return pdf.assign(**{out: pd.array(medians, dtype="Float64")})

    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    return df.groupBy(*keys).applyInPandas(walk, schema)


def ewma_variance(df: DataFrame, r: str, lam: float, init: int, out: str, *keys: str, first_day: int = 0) -> DataFrame:
    """Adds ``out``: exponentially weighted variance, null before its seed.

    The seed on day ``first_day + init - 1`` is the mean square of the
    ``init`` days up to it; then ``lam * before + (1 - lam) * r^2``. The
    recurrence is a weighted sum; weights are taken relative to the start of a
    block so short that none overflows, and a block starts from the last value of
    the one before (what lies further back weighs under 1e-100)."""
    if not 0.0 < lam < 1.0:
        raise ValueError(f"lambda must be in (0, 1), got {lam}")
    if init < 1:
        raise ValueError(f"init_window must be >= 1, got {init}")
    block = max(1, int(230 / -math.log(lam)))
    seed_day = first_day + init - 1
    t, square = F.col("t"), F.col(r) * F.col(r)
    seed = F.avg(square).over(trailing(init, *keys))
    step = F.when(t < seed_day, 0.0).when(t == seed_day, seed).otherwise((1.0 - lam) * square)
    at = F.pmod(t, F.lit(block))
    rows = df.withColumn("__u", step).withColumn("__b", F.floor(t / block)).withColumn("__w", F.pow(F.lit(lam), at.cast("double")))
    inside = Window.partitionBy(*keys, "__b").orderBy("t")
    rows = rows.withColumn("__h", F.col("__w") * F.sum(F.col("__u") / F.col("__w")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__p", F.lag("__h").over(over(*keys)))
    carried = F.coalesce(F.first("__p").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))
    return rows.withColumn(out, F.when(t >= seed_day, F.col("__h") + F.col("__w") * lam * carried)).drop("__u", "__b", "__w", "__h", "__p")


def capped_leverage(variance: Column, target: float, cap: float) -> Column:
    """min(target / annual volatility, cap); the cap where the variance is 0; null where it is null."""
    return F.when(variance == 0.0, F.lit(float(cap))).when(variance > 0.0, F.least(target / F.sqrt(DAYS * variance), F.lit(float(cap))))


def run_number(flag: Column, *keys: str) -> Column:
    """Equal within a run of days on which ``flag`` keeps its value."""
    return F.col("t") - F.row_number().over(Window.partitionBy(*keys, flag).orderBy("t"))
