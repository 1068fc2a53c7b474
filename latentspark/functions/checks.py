"""Input rules: one aggregate per table finds the first offending key, and the driver raises.

A rule can also ride along: a :class:`Watch` gathers the first offender while the
query that uses the table runs, and the sink raises before its result can be read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def finite(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def first_offender(df: DataFrame, bad: Column, keys: list[str], what: str) -> None:
    """Raises ValueError naming the least key for which ``bad`` holds."""
    _verdict(df.agg(*_gathered(bad, keys)).first().asDict(), keys, what)


def _gathered(bad: Column, keys: Sequence[str]) -> list[Column]:
    return [F.min(F.when(bad, F.struct(*keys))).alias("k"), F.count("*").alias("n")]


def _verdict(got: dict, keys: Sequence[str], what: str) -> None:
    if not got["n"]:
        raise ValueError(f"{what}: no rows")
    if got["k"] is not None:
        raise ValueError(f"{what} at " + ", ".join(f"{k}={got['k'][k]}" for k in keys))


class Watch:
    """``df`` is the table to go on with; after an action on it :meth:`settle` raises as :func:`first_offender` would, without a job of its own."""

    def __init__(self, df: DataFrame, bad: Column, keys: list[str], what: str):
        self.keys, self.what, self.seen = keys, what, Observation(f"watch-{uuid.uuid4().hex}")
        self.df = df.observe(self.seen, *_gathered(bad, keys))

    def settle(self) -> None:
        _verdict(self.seen.get, self.keys, self.what)


def write_watched(df: DataFrame, watches: Sequence[Watch], path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, which must not exist, if no watch has an offender: it is written aside, the
    watches settle in order, and only then it gets its name. A failed rule or task leaves nothing at ``path``."""
    spark, aside = df.sparkSession, f"{path}.writing-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop(path)):
        raise ValueError(f"{path} exists")
    try:
        df.write.parquet(aside)
        for w in watches:
            w.settle()
        if not system.rename(hadoop(aside), hadoop(path)):
            raise OSError(f"could not name {path}")
    finally:
        system.delete(hadoop(aside), True)
    return spark.read.schema(df.schema).parquet(path)


def returns_domain(df: DataFrame, r: str, keys: list[str], name: str = "returns") -> None:
    """Returns are finite and above -1."""
    first_offender(df, ~finite(r) | (F.col(r) <= -1.0), keys, f"{name} must be finite and > -1")


def all_finite(df: DataFrame, x: str, keys: list[str], name: str) -> None:
    first_offender(df, ~finite(x), keys, f"{name} must be finite")


def dense_days(df: DataFrame, keys: list[str]) -> None:
    """Days of each series run from 0 without gaps or repeats."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("a"), F.max("t").alias("b"))
    if not got.where("n <> d or a <> 0 or b <> n - 1").isEmpty():
        raise ValueError("days t must run 0..T-1 without gaps or repeats")


def scalar(ok: bool, what: str) -> None:
    """``ok`` is written so that NaN fails it."""
    if not ok:
        raise ValueError(what)


def positive(x: float, name: str) -> None:
    scalar(math.isfinite(x) and x > 0.0, f"{name} must be finite and > 0, got {x}")
