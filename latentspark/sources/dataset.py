"""Readers and writers: the four CSV tables of a dataset, its configuration,
golden cases, re-rank panels, and dated text tables."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INT_KEYS = ("n_states", "em_max_iter", "momentum_lookback", "carry_top_n", "carry_bottom_n", "rebalance_days", "train_min_days", "refit_days", "trading_days")
FLOAT_KEYS = ("em_tol", "var_floor", "vol_target", "portfolio_vol_target", "ewma_lambda", "leverage_cap", "gate_threshold", "cost_bps")
OPTIONAL_KEYS = ("gate_band", "transition_floor", "calm_guard")


@dataclass(frozen=True)
class Dataset:
    """``index`` (t, date, x), ``trend`` and ``spot`` (t, asset_idx, r), ``diffs`` (t, asset_idx, diff), ``states`` (t, state), ``config``."""

    index: DataFrame
    trend: DataFrame
    spot: DataFrame
    diffs: DataFrame
    states: DataFrame
    config: dict


def validate_config(raw: dict) -> dict:
    """Types are strict: integers are not 3.0, booleans are not integers, numbers are finite. Optional keys default to 0."""
    cfg = {}
    for k in (*INT_KEYS, *FLOAT_KEYS, "gate_mode"):
        if k not in raw:
            raise ValueError(f"config lacks {k}")
    for k in INT_KEYS:
        if isinstance(raw[k], bool) or not isinstance(raw[k], int):
            raise ValueError(f"config {k} must be an integer, got {raw[k]!r}")
        cfg[k] = raw[k]
    for k in (*FLOAT_KEYS, *OPTIONAL_KEYS):
        v = raw.get(k, 0.0)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            raise ValueError(f"config {k} must be a finite number, got {v!r}")
        cfg[k] = float(v)
    if not isinstance(raw["gate_mode"], str):
        raise ValueError("config gate_mode must be a string")
    return cfg | {"gate_mode": raw["gate_mode"]}


def load_config(spark: SparkSession, path: str) -> dict:
    return validate_config(json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns but ``date`` are doubles; the header gives their names."""
    header = spark.read.text(path).first()[0].split(",")
    if header[0] != "date":
        raise ValueError(f"{path}: the first column must be date")
    schema = ", ".join(f"`{c}` {'date' if c == 'date' else 'double'}" for c in header)
    return spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True, mode="FAILFAST", dateFormat="yyyy-MM-dd")


def unpivot(df: DataFrame, prefix: str, value: str) -> DataFrame:
    """Columns ``prefix``0, 1, ... as (t, asset_idx, value)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        raise ValueError(f"no column starts with {prefix}")
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("asset_idx"), F.col(c).alias(value)) for i, c in enumerate(cols)))).alias("v")
    return df.select("t", pairs).select("t", "v.asset_idx", f"v.{value}")


def load_dataset(spark: SparkSession, folder: str) -> Dataset:
    """Reads the folder's tables and joins them on dates, which must be the same in all four."""
    index, trend, fx = (_csv(spark, f"{folder}/{n}.csv") for n in ("market_index", "trend_assets", "fx_carry"))
    states = _csv(spark, f"{folder}/true_states.csv")
    calendar = index.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t"))  # a row per day
    n = index.count()
    if not n or index.select("date").distinct().count() != n:
        raise ValueError("dates must be present and distinct")
    dated = [df.join(calendar, "date") for df in (index, trend, fx, states)]
    if any(df.count() != n or raw.count() != n for df, raw in zip(dated, (index, trend, fx, states), strict=True)):
        raise ValueError("tables disagree on dates")
    index, trend, fx, states = dated
    if not states.where("state is null or state not in (0, 1, 2)").isEmpty():
        raise ValueError("true states must be 0, 1 or 2")
    return Dataset(
        index.select(F.lit("index").alias("series_id"), "t", "date", F.col("ret").alias("x")),
        unpivot(trend, "asset_", "r"), unpivot(fx, "spot_ret_", "r"), unpivot(fx, "rate_diff_", "diff"),
        states.select(F.lit("index").alias("series_id"), "t", F.col("state").cast("int").alias("state")), load_config(spark, f"{folder}/config.json"),
    )


def write_dataset(ds: Dataset, folder: str) -> None:
    """One CSV folder per table, ISO dates, ten decimals, and the configuration; rows are wide again, and :func:`load_dataset` reads them."""
    dates = ds.index.select("t", "date")

    def wide(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
        out = dates
        for df, value, prefix in parts:
            n = df.agg(F.max("asset_idx")).first()[0] + 1
            p = df.groupBy("t").pivot("asset_idx", list(range(n))).agg(F.format_string("%.10f", F.first(value)))
            out = out.join(p.select("t", *(F.col(str(i)).alias(f"{prefix}{i}") for i in range(n))), "t")
        return out.orderBy("t").drop("t").coalesce(1)

    put = lambda df, name: df.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True, dateFormat="yyyy-MM-dd")
    put(ds.index.orderBy("t").select("date", F.format_string("%.10f", "x").alias("ret")).coalesce(1), "market_index")
    put(wide([(ds.trend, "r", "asset_")]), "trend_assets")
    put(wide([(ds.spot, "r", "spot_ret_"), (ds.diffs, "diff", "rate_diff_")]), "fx_carry")
    put(ds.states.join(dates, "t").orderBy("t").select("date", "state").coalesce(1), "true_states")
    text = ds.index.sparkSession.createDataFrame([(json.dumps(ds.config),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/config.json")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, expect, tol), a row per scalar of a file of golden cases."""
    schema = "cases array<struct<name string, expect map<string,double>, tol double>>"
    cases = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("cases").alias("c"))
    return cases.select("c.name", "c.tol", F.explode("c.expect").alias("key", "expect")).select("name", "key", "expect", "tol")


def rerank_panel(spark: SparkSession, n_days: int, switch_days: list[int], diffs: list[list[float]]) -> DataFrame:
    """(t, asset_idx, diff) that holds row k of ``diffs`` from ``switch_days[k]`` on."""
    if not switch_days or switch_days[0] != 0 or any(a >= b for a, b in zip(switch_days, switch_days[1:], strict=False)) or len(diffs) != len(switch_days):
        raise ValueError("switch_days must start at 0 and increase, one per row of diffs")
    if len({len(d) for d in diffs}) != 1:
        raise ValueError("rows of diffs must have equal length")
    ends = [*switch_days[1:], n_days]
    rows = [(s, e, i, float(v)) for s, e, d in zip(switch_days, ends, diffs, strict=True) for i, v in enumerate(d)]
    spans = spark.createDataFrame(rows, "s int, e int, asset_idx int, diff double").where("s < e")
    return spans.select(F.explode(F.sequence("s", F.col("e") - 1)).alias("t"), "asset_idx", "diff").where(F.col("t") < n_days)


def read_dated_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(date, names...) from the first run of comma-separated rows that begin with an eight-digit date, percent to fractions.

    ``path`` is one file; a line's place is where its split of the file begins and, within it, its number, however
    splits are dealt to tasks. Values of -99 or less mark missing data and raise."""

    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("i"))
    is_dated = F.col("value").rlike(r"^\s*[0-9]{8}\s*,")
    first = lines.where(is_dated).agg(F.min("i").alias("i")).first()["i"]
    if first is None:
        raise ValueError(f"{path}: no dated rows")
    at = lambda r: F.struct(F.lit(r["block"]).cast("long").alias("block"), F.lit(r["line"]).cast("long").alias("line"))
    stop = lines.where((F.col("i") > at(first)) & ~is_dated).agg(F.min("i").alias("i")).first()["i"]
    rows = lines.where(is_dated) if stop is None else lines.where(is_dated & (F.col("i") < at(stop)))
    cells = F.split(F.trim("value"), r"\s*,\s*")
    table = rows.select(F.to_date(cells[0], "yyyyMMdd").alias("date"), *((cells[k + 1].cast("double") / 100.0).alias(c) for k, c in enumerate(names)))
    bad = table.where(" or ".join(f"`{c}` is null or `{c}` <= -0.99" for c in names))
    if not bad.isEmpty():
        raise ValueError(f"{path}: missing values")
    return table


def to_markdown(df: DataFrame, digits: int = 2) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])
