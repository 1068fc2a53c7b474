"""A deterministic six-asset panel over the driver's tables.

Assets are return flag and line status; a day's price is revenue over quantity,
its differential the mean discount less five percent; both are carried forward
over days without sales. The fact table is read once and aggregated to a row
per day and asset; everything after that is as small as the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentspark.functions.windows import over, sofar

_KEPT: dict[tuple[str, str], DataFrame] = {}

#: The same panel in DuckDB: panel (t, d, asset_idx, r, diff) and idx (t, x).
SQL = """
raw as (select cast(l_shipdate as date) as d, concat(l_returnflag, l_linestatus) as asset,
    round(sum(l_extendedprice) / sum(l_quantity), 10) as price, round(avg(l_discount) - 0.05::double, 10) as rd from lineitem group by 1, 2),
days as (select d, (row_number() over (order by d) - 1)::int as t from (select distinct d from raw)),
assets as (select asset, (row_number() over (order by asset) - 1)::int as asset_idx from (select distinct asset from raw)),
filled as (select t, d, asset_idx, last_value(price ignore nulls) over w as price, last_value(rd ignore nulls) over w as rd
    from days cross join assets left join raw using (d, asset) window w as (partition by asset_idx order by t rows unbounded preceding)),
panel as (select t, d, asset_idx, coalesce(0.02::double * ln(price / lag(price) over (partition by asset_idx order by t)), 0)::double as r, coalesce(rd, 0)::double as diff from filled),
idx as (select t, avg(r) as x from panel group by t)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, date, asset_idx, r, diff), kept in memory for the session: it has a row per day and asset."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _KEPT:
        return _KEPT[key]
    asset = F.concat("l_returnflag", "l_linestatus").alias("asset")
    raw = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), asset)
        .agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 10).alias("price"), F.round(F.avg("l_discount") - 0.05, 10).alias("rd"))
        .persist()
    )
    days = raw.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t"))
    assets = raw.select("asset").distinct().select("asset", (F.row_number().over(Window.orderBy("asset")) - 1).alias("asset_idx"))
    grid = days.crossJoin(F.broadcast(assets)).join(raw, ["date", "asset"], "left")
    w = sofar("asset_idx")
    filled = grid.select("t", "date", "asset_idx", F.last("price", True).over(w).alias("price"), F.last("rd", True).over(w).alias("rd"))
    move = 0.02 * F.log(F.col("price") / F.lag("price").over(over("asset_idx")))
    out = filled.select("t", "date", "asset_idx", F.coalesce(move, F.lit(0.0)).alias("r"), F.coalesce("rd", F.lit(0.0)).alias("diff")).persist()
    _KEPT[key] = out
    return out


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, x): the mean return over assets."""
    return panel(spark, sf_dir).groupBy("t").agg(F.avg("r").alias("x")).select(F.lit("index").alias("series_id"), "t", "x")
