"""Exact ranks, quantiles and what rests on them, for any number of rows and any share of ties.

Rows are first counted by distinct value, which happens before anything moves,
so a value that a third of all rows hold is one row. The distinct values are
dealt by range, and running counts give every value's ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.ordered import ROWS, _renamed, _same, running_totals
from latentspark.sources.scratch import sized, written


def value_ranks(df: DataFrame, x: str, keys: Sequence[str] = (), sums: dict | None = None, rows: int = ROWS) -> DataFrame:
    """(keys, x, n, before_n, ...): each distinct value, how many rows hold it and how many hold smaller ones.

    Rows whose value is null or NaN don't count. ``sums`` names further columns to add up per value."""
    counted = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*keys, x).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in (sums or {}).items()))
    return running_totals(counted, keys, [x], ["n"], rows)


def average_ranks(df: DataFrame, x: str, keys: Sequence[str] = (), out: str = "rank", rows: int = ROWS) -> DataFrame:
    """(keys, x, out): the rank from 1 of each distinct value; ties share their mean rank."""
    return value_ranks(df, x, keys, rows=rows).select(*keys, x, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(out))


def quantiles(df: DataFrame, x: str, at: Sequence[float], keys: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """(keys, q, value): exact quantiles, linear between the two nearest order statistics.

    Groups without values have no row. No group is gathered anywhere: the two values are
    those whose running counts enclose the position."""
    if not at or not all(0.0 <= q <= 1.0 for q in at):
        raise ValueError("quantiles must be in [0, 1]")
    ranked = written(value_ranks(df.select(*keys, F.col(x).cast("double").alias("x")), "x", keys, rows=rows), "value-ranks")
    sizes = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    targets = sizes.select(*keys, F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("q"), "total").withColumn("h", (F.col("total") - 1) * F.col("q"))
    targets = sized(written(_renamed(targets.drop("total"), keys), "targets"))
    last = F.col("before_n") + F.col("n") - 1
    covers = lambda p: (F.col("before_n") <= p) & (p <= last)
    low, high = F.floor("h"), F.ceil("h")
    hits = _same(ranked, targets, keys).where(covers(low) | covers(high))
    ends = hits.groupBy(*keys, "q", "h").agg(F.max(F.when(covers(low), F.col("x"))).alias("a"), F.max(F.when(covers(high), F.col("x"))).alias("b"))
    share = F.col("h") - F.floor("h")
    return ends.select(*keys, "q", F.when(share == 0, F.col("a")).otherwise(F.col("a") + share * (F.col("b") - F.col("a"))).alias("value"))


def winsorize_mad(df: DataFrame, x: str, width: float = 8.0, keys: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """``x`` clipped to median +- width * 1.4826 * MAD of its group, unchanged where the MAD is 0; exact at any size.

    Null and NaN values stay and don't count. Names that begin with ``of_`` and ``mad_`` are used inside."""
    mid = sized(written(_renamed(quantiles(df, x, [0.5], keys, rows).select(*keys, F.col("value").alias("mad_mid")), keys), "medians"))
    off = _same(df, mid, keys, "left").withColumn("mad_off", F.abs(F.col(x) - F.col("mad_mid")))
    spread = sized(written(_renamed(quantiles(off, "mad_off", [0.5], keys, rows).select(*keys, F.col("value").alias("mad_spread")), keys), "spreads"))
    reach = width * 1.4826 * F.col("mad_spread")
    clipped = F.least(F.greatest(F.col(x), F.col("mad_mid") - reach), F.col("mad_mid") + reach)
    usable = (F.col("mad_spread") > 0) & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    return _same(off, spread, keys, "left").withColumn(x, F.when(usable, clipped).otherwise(F.col(x))).drop("mad_mid", "mad_off", "mad_spread")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """(keys, auc): Mann-Whitney with average ranks; NaN where one class is missing.

    Counts of both classes by distinct score are all that is ranked. Rows with a null label or score don't count."""
    have = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    y = F.col(label).cast("boolean").cast("long")
    ranked = value_ranks(have.select(*keys, F.col(score).cast("double").alias("x"), y.alias("y")), "x", keys, {"n1": F.col("y")}, rows)
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    got = ranked.groupBy(*keys).agg(F.sum(F.col("n1") * rank).alias("s"), F.sum("n1").cast("double").alias("n1"), F.sum(F.col("n") - F.col("n1")).cast("double").alias("n0"))
    auc = F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))).otherwise(float("nan"))
    return got.select(*keys, auc.alias("auc"))
