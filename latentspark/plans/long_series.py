"""Queries over the event stream, whose series are long: every one is cut over many tasks.

A series is an event type, its day the event's number. SQL says the same
row by row, by recursion or plain windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from latentspark.operators import band_scan, hmm_kernel, hmm_long, hmm_scan, median_scan, ordered, ranks
from latentspark.sources import scratch
from latentspark.sources.scratch import written
from latentspark.streaming import ordered_filter

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 8):
    """Registers a query under its function's name; doubles are rounded as in its SQL."""

    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*((F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields))

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_series(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, t, x): event type, number and value."""
    return table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("t"), F.col("value").alias("x"))


# ---- hidden Markov passes of a given model

MODEL = hmm_kernel.HMMParams(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[20.0], [80.0]]), np.array([[900.0], [2500.0]]))

_LOG_DENSITY = lambda m, v: f"(-0.5::double * (ln(2 * pi()) + ln({v}::double) + (value - {m}) * (value - {m}) / {v}::double))"
_EM = f"em as materialized (select event_type as series_id, event_id as t, row_number() over (partition by event_type order by event_id) as i, exp({_LOG_DENSITY(20, 900)}) as b0, exp({_LOG_DENSITY(80, 2500)}) as b1 from events)"
_FORWARD = """fw(series_id, i, c, a0, a1) as (
    select series_id, i, 0.5 * b0 + 0.5 * b1, 0.5 * b0 / (0.5 * b0 + 0.5 * b1), 0.5 * b1 / (0.5 * b0 + 0.5 * b1) from em where i = 1
    union all select series_id, i, u0 + u1, u0 / (u0 + u1), u1 / (u0 + u1) from (select em.series_id, em.i, (0.95 * a0 + 0.1 * a1) * b0 as u0, (0.05 * a0 + 0.9 * a1) * b1 as u1
      from fw join em on em.series_id = fw.series_id and em.i = fw.i + 1))"""
_BACKWARD = """bw(series_id, i, v0, v1) as (
    select series_id, max(i), 1::double, 1::double from em group by series_id
    union all select series_id, i, u0 / (u0 + u1), u1 / (u0 + u1) from (select em.series_id, bw.i - 1 as i, 0.95 * b0 * v0 + 0.05 * b1 * v1 as u0, 0.1 * b0 * v0 + 0.9 * b1 * v1 as u1
      from bw join em on em.series_id = bw.series_id and em.i = bw.i where bw.i > 1))"""


@query(f"with recursive {_EM}, {_FORWARD}, {_BACKWARD} select series_id, t, round(a0, 8) + 0 as filtered, round(a0 * v0 / (a0 * v0 + a1 * v1), 8) + 0 as smoothed from fw join bw using (series_id, i) join em using (series_id, i)")
def event_posteriors(spark, d):
    """Filtered and smoothed probability of the low state at every event."""
    return hmm_scan.posteriors(event_series(spark, d), MODEL).select("series_id", "t", F.col("filtered")[0].alias("filtered"), F.col("smoothed")[0].alias("smoothed"))


@query(f"with recursive {_EM}, {_FORWARD} select series_id, count(*) as n, round(sum(ln(c)), 6) + 0 as log_likelihood from fw group by series_id", digits=6)
def event_likelihood(spark, d):
    found = hmm_scan.posteriors(event_series(spark, d), MODEL, smooth=False)
    return found.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("log_density").alias("log_likelihood"))


@query(digits=6)
def event_fit(spark, d):
    """Eight rounds of the fit of two states to the longest event type's values, its series cut into chunks: likelihood and means."""
    x = event_positions(spark, d)
    longest = x.groupBy("series_id").count().orderBy(F.col("count").desc(), "series_id").first()
    if longest is None:
        return spark.createDataFrame([], "series_id string, n_iter int, log_likelihood double, low double, high double")
    one = x.where(F.col("series_id") == longest["series_id"]).select("t", "x")
    p, r = hmm_long.fit_long(one, 2, max_iter=8, rows=max(1, min(100_000, longest["count"] // 16)))
    return spark.createDataFrame([(longest["series_id"], r.n_iter, float(r.log_likelihood), *map(float, p.means[:, 0]))], "series_id string, n_iter int, log_likelihood double, low double, high double")


def _micro(x: str) -> str:
    return f"round(1e6::double * {x})::bigint"


_BEST = f"""sc as materialized (select event_type as series_id, event_id as t, row_number() over (partition by event_type order by event_id) as i, {_micro(_LOG_DENSITY(20, 900))} as s0, {_micro(_LOG_DENSITY(80, 2500))} as s1 from events),
    lp as (select {_micro("ln(0.5::double)")} as p, {_micro("ln(0.95::double)")} as a00, {_micro("ln(0.05::double)")} as a01, {_micro("ln(0.1::double)")} as a10, {_micro("ln(0.9::double)")} as a11),
    best(series_id, i, m0, m1, f0, f1) as (
    select series_id, i, p + s0, p + s1, 0, 0 from sc, lp where i = 1
    union all select sc.series_id, sc.i, greatest(m0 + a00, m1 + a10) + s0, greatest(m0 + a01, m1 + a11) + s1, case when m0 + a00 >= m1 + a10 then 0 else 1 end, case when m0 + a01 >= m1 + a11 then 0 else 1 end
      from best join sc on sc.series_id = best.series_id and sc.i = best.i + 1 cross join lp),
    path(series_id, i, state) as (
    select series_id, i, case when m0 >= m1 then 0 else 1 end from best where (series_id, i) in (select series_id, max(i) from sc group by series_id)
    union all select path.series_id, path.i - 1, case when path.state = 0 then f0 else f1 end from path join best on best.series_id = path.series_id and best.i = path.i where path.i > 1)"""


@query(f"with recursive {_BEST} select series_id, t, state from path join sc using (series_id, i)")
def event_best_path(spark, d):
    """The most likely states of every event type's events."""
    return hmm_scan.best_path(event_series(spark, d), MODEL)


# ---- positions, bounded and running windows


def event_positions(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, at, x, t): events with their position among their type's."""
    rows = event_series(spark, d).withColumnRenamed("t", "at")
    return ordered.numbered(rows, ["series_id"], ["at"])


@query("select event_type as series_id, event_id as at, row_number() over (partition by event_type order by event_id) - 1 as t from events")
def event_numbers(spark, d):
    return event_positions(spark, d).drop("x")


_RUN = "partition by event_type order by event_id"


@query(
    f"""select event_type as series_id, event_id as at, case when n >= 21 then round(sqrt(q), 8) + 0 end as rms, round(value - before, 8) + 0 as change, round(late, 8) + 0 as late from (
    select *, row_number() over ({_RUN}) as n, avg(value * value) over ({_RUN} rows between 20 preceding and current row) as q, lag(value) over ({_RUN}) as before,
      coalesce(lag(value, 5) over ({_RUN}), first_value(value) over ({_RUN})) as late from events)"""
)
def event_rolling(spark, d):
    """Root mean square of the last 21 events, change from the event before, and the value five events late."""
    x = F.col("x")
    columns = {
        "rms": lambda w: F.when(F.col("t") >= 20, F.sqrt(F.avg(x * x).over(w.rowsBetween(-20, 0)))),
        "change": lambda w: x - F.lag(x).over(w),
        "late": lambda w: F.coalesce(F.lag(x, 5).over(w), F.first(x).over(w)),
    }
    return ordered.trailing(event_positions(spark, d), ["series_id"], "t", 20, columns, rows=1_000).select("series_id", "at", *columns)


@query(
    f"""with e as (select *, product(1 + (value - 50) / 1e5::double) over ({_RUN} rows unbounded preceding) as equity, sum(value) over ({_RUN} rows unbounded preceding) as total from events)
    select event_type as series_id, event_id as at, round(equity, 8) + 0 as equity, round(total, 6) + 0 as total, round(equity / max(equity) over ({_RUN} rows unbounded preceding) - 1, 8) + 0 as drawdown from e"""
)
def event_drawdown(spark, d):
    """Compounded small returns (value less 50, over 100,000), running sum, and the fall from the highest so far."""
    r = (F.col("x") - 50.0) / 1e5
    curve = ordered.running(event_positions(spark, d), ["series_id"], "t", {"equity": ("product", 1.0 + r), "total": ("sum", F.col("x"))}, rows=1_000)
    top = ordered.running(written(curve, "equity"), ["series_id"], "t", {"top": ("max", F.col("equity"))}, rows=1_000)
    return top.select("series_id", "at", "equity", F.round("total", 6).alias("total"), (F.col("equity") / F.col("top") - 1.0).alias("drawdown"))


# ---- ranks and quantiles of whole tables


@query("select q, round(v, 8) + 0 as value from (select unnest([0.01, 0.25, 0.5, 0.75, 0.99])::double as q, unnest(quantile_cont(l_extendedprice::double, [0.01, 0.25, 0.5, 0.75, 0.99])) as v from lineitem)")
def line_price_quantiles(spark, d):
    return ranks.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99])


_SIXTHS = "[1 / 6.0::double, 0.5::double, 5 / 6.0::double]"


@query(f"select event_type, round(unnest({_SIXTHS}), 8) + 0 as q, round(unnest(quantile_cont(value, {_SIXTHS})), 8) + 0 as value from events group by event_type")
def event_quantiles(spark, d):
    """The thirds' middles of every event type, where a model's means start."""
    return ranks.quantiles(table(spark, d, "events"), "value", [1 / 6, 0.5, 5 / 6], ["event_type"])


@query("""select l_orderkey, l_linenumber, round(case when s > 0 then least(greatest(x, m - 3 * 1.4826::double * s), m + 3 * 1.4826::double * s) else x end, 8) + 0 as price from (
    select *, median(abs(x - m)) over (partition by l_returnflag) as s from (select l_orderkey, l_linenumber, l_returnflag, l_extendedprice::double as x, median(l_extendedprice::double) over (partition by l_returnflag) as m from lineitem))""")
def line_price_winsorized(spark, d):
    """Prices clipped at three robust deviations from their return flag's median."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return ranks.winsorize_mad(rows, "price", 3.0, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "price")


@query("select doc_id, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as rank from documents where n_chars is not null")
def document_length_ranks(spark, d):
    """Average rank of every document's length among all documents."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(ranks.average_ranks(docs, "n_chars"), "n_chars").select("doc_id", "rank")


# ---- as-of joins


_VIEWS = "v as (select user_id, ts, event_id, value from events where event_type = 'view' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1)"


@query(f"with {_VIEWS} select p.event_id, v.event_id as view_id, round(v.value, 8) + 0 as view_value from (select * from events where event_type = 'purchase') p asof left join v on p.user_id = v.user_id and p.ts >= v.ts")
def purchase_as_of_view(spark, d):
    """Each purchase with its user's last view up to then."""
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    day = lambda ts: F.unix_date(ts.cast("date")).cast("long")
    got = ordered.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "viewed", ["view_id", "view_value"], day)
    return got.select("event_id", "view_id", "view_value")


@query(f"""with {_VIEWS} select p.event_id, case when v.ts >= p.ts - interval 2 day then v.event_id end as view_id from (select * from events where event_type = 'purchase') p
    asof left join v on p.user_id = v.user_id and p.ts > v.ts""")
def purchase_after_recent_view(spark, d):
    """Each purchase with its user's last view before it, if that is at most two days old."""
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id"))
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("ts") - F.expr("interval 2 days")).alias("since"))
    day = lambda ts: F.unix_date(ts.cast("date")).cast("long")
    return ordered.as_of(left, views, ["user_id"], "ts", "viewed", ["view_id"], day, inclusive=False, not_before=F.col("since")).select("event_id", "view_id")


# ---- the no-trade band


@query(
    """with recursive g as materialized (select event_type as series_id, event_id as t, row_number() over (partition by event_type order by event_id) as i, least(value / 100, 1::double) as x from events),
    walk(series_id, i, o) as (select distinct series_id, 0::bigint, 1::double from g
      union all select w.series_id, g.i, case when abs(g.x - w.o) > 0.25::double then g.x else w.o end from walk w join g on g.series_id = w.series_id and g.i = w.i + 1)
    select series_id, t, round(o, 8) + 0 as x from walk join g using (series_id, i)"""
)
def event_band(spark, d):
    """A gate made of the events' values, followed only when it is a quarter away from what is held."""
    gate = event_series(spark, d).withColumn("x", F.least(F.col("x") / 100.0, F.lit(1.0)))
    return band_scan.apply_band(gate, 0.25)


# ---- streaming in event-time order


def _stream_sql() -> str:
    em = _EM.replace("event_type as series_id", "event_type || '/' || user_id as series_id").replace("partition by event_type order by event_id", "partition by event_type, user_id order by ts, event_id")
    em = em.replace("from events", "from events where epoch_ms(ts) < (select epoch_ms(max(ts)) - 3600000 from events)")
    return f"with recursive {em}, {_FORWARD} select series_id, t as seq, round(a0, 8) + 0 as p0 from fw join em using (series_id, i)"


@query(_stream_sql())
def stream_filter_in_order(spark, d):
    """Posterior of the low state at every event of every type and user that the stream's watermark, one hour behind, has passed."""
    at = scratch.new_path(spark, "ordered-filter")
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    no = F.lit(None).cast("string")
    rows = events.select(F.concat_ws("/", "event_type", "user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("x"), no.alias("op"), no.alias("model"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = ordered_filter.filter_in_order(rows, MODEL, "1 hour")
        run = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(ordered_filter.OUTPUT).parquet(f"{at}/rows").where("error is null").select("series_id", "seq", F.col("alpha")[0].alias("p0"))


# ---- order statistics of all values so far


@query(
    f"""with e as materialized (select event_type as series_id, event_id as t, value, row_number() over ({_RUN}) as n from events)
    select series_id, t, round(quantile_cont(value, 0.5) over (partition by series_id order by t rows unbounded preceding), 8) + 0 as median from e"""
)
def event_expanding_median(spark, d):
    """Median of every event type's values up to each event."""
    return median_scan.expanding_median(event_series(spark, d))


@query(
    f"""with e as (select event_type as series_id, event_id as n, row_number() over ({_RUN}) - 1 as t, case when row_number() over ({_RUN}) >= 21 then sqrt(avg(value * value) over ({_RUN} rows between 20 preceding and current row)) end as vol from events),
    m as (select *, quantile_cont(vol, 0.5) over (partition by series_id order by t rows unbounded preceding) as med from e)
    select series_id, n as at, round(case when t < 60 then 1 when vol > 0 then least(med / vol, 1) else 1 end::double, 8) + 0 as gate from m"""
)
def event_vol_gate(spark, d):
    """The volatility-ratio gate of every event type from its 61st event on: median of the rolling level so far over the level, at most 1."""
    vol = ordered.trailing(event_positions(spark, d), ["series_id"], "t", 20, {"vol": lambda w: F.when(F.col("t") >= 20, F.sqrt(F.avg(F.col("x") * F.col("x")).over(w.rowsBetween(-20, 0))))}, rows=1_000)
    vol = written(vol.select("series_id", "at", "t", "vol"), "vol")
    med = median_scan.expanding_median(vol.select("series_id", "t", F.col("vol").alias("x"))).withColumnRenamed("median", "med")
    gate = F.when(F.col("t") < 60, 1.0).when(F.col("vol") > 0.0, F.least(F.col("med") / F.col("vol"), F.lit(1.0))).otherwise(1.0)
    return vol.join(med, ["series_id", "t"]).select("series_id", "at", gate.alias("gate"))
