"""All queries of the library over the driver's tables, and their DuckDB SQL.

Doubles are rounded to eight decimals on both sides.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from latentspark.functions import windows as W
from latentspark.operators import backtest as B
from latentspark.operators import costs as C
from latentspark.operators import evaluation as E
from latentspark.operators import gates as G
from latentspark.operators import hmm, hmm_kernel
from latentspark.operators import strategies as S
from latentspark.plans import golden, long_series, market_study, study
from latentspark.plans.panel import SQL as PANEL
from latentspark.plans.panel import index, panel
from latentspark.sources import dataset, dgp, scratch
from latentspark.streaming import regime_filter

CFG = {
    "momentum_lookback": 252, "vol_target": 0.10, "portfolio_vol_target": 0.10, "ewma_lambda": 0.94, "leverage_cap": 4.0,
    "carry_top_n": 3, "carry_bottom_n": 3, "rebalance_days": 21, "cost_bps": 5.0, "train_min_days": 504,
}
FIRST, START = 503, 504  # first gated day, first day of the metric window

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*((F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields))


def query(sql: str | None = None, digits: int = 8):
    """Registers a query under its function's name. ``sql`` is its last select,
    with ``r8(x)`` for rounding, over the named tables of ``_WITH``."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | long_series.queries()


def oracle_sql() -> dict[str, str]:
    return {k: v if v.startswith("with ") else _sql(v) for k, v in _SQL.items()} | long_series.oracle_sql()


def _ewma(name: str, source: str, x: str, key: str, lam: float, init: int, first: int = 0) -> str:
    s0 = first + init - 1
    return f"""{name} as (select *, case when t >= {s0} then pow({lam}::double, t - {s0}) * sum(case when t = {s0} then seed when t > {s0} then {1 - lam:.10g}::double * {x} * {x} * pow({lam}::double, {s0} - t) else 0 end)
    over (partition by {key} order by t rows unbounded preceding) end as var
    from (select *, avg({x} * {x}) over (partition by {key} order by t rows between {init - 1} preceding and current row) as seed from {source}))"""


def _lev(var: str) -> str:
    return f"(case when {var} = 0 then 4.0::double else least(0.1::double / sqrt(252 * {var}), 4.0::double) end)"


_SHARPE = "case when stddev_pop({0}) > 0 then sqrt(252) * avg({0}) / stddev_pop({0}) else 0 end"

_WITH = [
    PANEL,
    _ewma("aew", "panel", "r", "asset_idx", 0.94, 252),
    """growth as (select t, asset_idx, sum(ln(1 + r)) over (partition by asset_idx order by t rows between 251 preceding and current row) as lg,
    product(1 + r) over (partition by asset_idx order by t rows between 251 preceding and current row) - 1 as tr from panel)""",
    f"mom as (select a.t, a.asset_idx, case when a.t >= 251 then sign(g.tr) * {_lev('a.var')} / 6 else 0 end as p from aew a join growth g using (t, asset_idx))",
    """ranked as (select t as t0, asset_idx, row_number() over (partition by t order by diff desc, asset_idx) as k from panel where t % 21 = 0)""",
    """car as (select panel.t, panel.asset_idx, case when k <= 3 then 1 / 3.0::double else -1 / 3.0::double end as p from panel join ranked on t0 = t - t % 21 and ranked.asset_idx = panel.asset_idx)""",
    "ctr as (select t, asset_idx, r + coalesce(lag(diff) over (partition by asset_idx order by t), 0) / 252 as r from panel)",
    "pos as (select 'momentum' as run_id, t, asset_idx, p from mom union all select 'carry', t, asset_idx, p from car)",
    "rets as (select 'momentum' as run_id, t, asset_idx, r from panel union all select 'carry', t, asset_idx, r from ctr)",
    "trd as (select *, coalesce(lag(p) over (partition by run_id, asset_idx order by t), 0) as prev from pos)",
    "flow as (select run_id, t, sum(prev * r) as gross, sum(abs(p - prev)) as turnover from trd join rets using (run_id, t, asset_idx) group by run_id, t)",
    "net as (select *, gross - 0.0005::double * turnover as net from flow)",
    "bt as (select *, product(1 + net) over (partition by run_id order by t rows unbounded preceding) as equity from net)",
    "dd as (select *, equity / max(equity) over (partition by run_id order by t rows unbounded preceding) - 1 as drawdown from bt)",
    "months as (select run_id, date_trunc('month', d) as m, product(1 + net) - 1 as r from bt join days using (t) group by 1, 2)",
    "blocks as (select run_id, t // 21 as b, product(1 + net) - 1 as r from bt where t < 21 * ((select count(*) from days) // 21) group by 1, 2)",
    "raw_book as (select 'book' as run_id, t, 0.5::double * sum(net) as net from net group by t)",
    _ewma("pew", "raw_book", "net", "run_id", 0.94, 21, 252),
    f"scale as (select run_id, t, case when t < 272 then 1 else {_lev('var')} end as scale from pew)",
    "spos as (select pos.run_id, t, asset_idx, p * scale as p from pos join scale using (t))",
    "strd as (select *, coalesce(lag(p) over (partition by run_id, asset_idx order by t), 0) as prev from spos)",
    "sflow as (select run_id, t, sum(prev * r) as gross, sum(abs(p - prev)) as turnover from strd join rets using (run_id, t, asset_idx) group by run_id, t)",
    "rms as (select t, x, case when t >= 20 then sqrt(avg(x * x) over (order by t rows between 20 preceding and current row)) end as vol from idx)",
    "medv as (select t, vol, (select quantile_cont(b.vol, 0.5) from rms b where b.t <= rms.t) as med from rms)",
    f"volgate as (select t, case when t < {FIRST} then 1 when vol > 0 then least(med / vol, 1) else 1 end::double as gate from medv)",
    _ewma("iew", "(select 'i' as k, t, x from idx)", "x", "k", 0.94, 21),
    "emed as (select t, sqrt(var) as vol, (select quantile_cont(sqrt(b.var), 0.5) from iew b where b.t <= iew.t) as med from iew)",
    f"ewgate as (select t, case when t < {FIRST} then 1 when vol > 0 then least(med / vol, 1) else 1 end::double as gate from emed)",
    "cuts as (select quantile_cont(vol, [1 / 3.0::double, 2 / 3.0::double]) as q from rms)",
    "states as (select t, case when vol is null or vol <= q[1] then 0 when vol <= q[2] then 1 else 2 end as state from rms, cuts)",
    f"orgate as (select t, case when t >= {FIRST} and coalesce(lead(state) over (order by t), -1) = 2 then 0 else 1 end::double as gate from states)",
    "gset as (select 'unfiltered' as g, t, 1::double as gate from idx union all select 'vol', t, gate from volgate union all select 'ewma', t, gate from ewgate union all select 'oracle', t, gate from orgate)",
    "gpos as (select g, run_id, t, asset_idx, p * gate as p from spos join gset using (t))",
    "gtrd as (select *, coalesce(lag(p) over (partition by g, run_id, asset_idx order by t), 0) as prev from gpos)",
    "book as (select g as run_id, t, 0.5::double * sum(prev * r) as gross, 0.5::double * sum(abs(p - prev)) as turnover from gtrd join rets using (run_id, t, asset_idx) group by g, t)",
    "epi as (select min(t) as first_t, max(t) + 1 as end_t from (select t, t - row_number() over (order by t) as run from states where state = 2) group by run having min(t) >= 504)",
    "assume as (select asset_idx, (1 + asset_idx)::double as hs, 5e9::double + 1e9::double * asset_idx as adv, 0.01::double as sg from assets)",
]


def _names(part: str) -> list[str]:
    return re.findall(r"(?:^|\n)\s*(\w+) as \((?=select)", part)


def _rounding(select: str) -> str:
    """``r8(x)`` spelled out."""
    while (at := select.find("r8(")) >= 0:
        end, depth = at + 3, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(select[end], 0)
            end += 1
        select = f"{select[:at]}(round(({select[at + 3 : end - 1]})::double, 8) + 0){select[end:]}"
    return select


def _sql(select: str) -> str:
    """The tables that ``select`` needs, directly or not, before it."""
    parts = [(set(_names(p)), p.strip()) for p in _WITH]
    need, chosen = set(re.findall(r"\w+", select)), []
    for names, p in reversed(parts):
        if names & need:
            chosen.append(p)
            need |= set(re.findall(r"\w+", p))
    body = _rounding(select)
    return ("with " + ",\n".join(reversed(chosen)) + "\n" if chosen else "") + body


# ---- sources and the panel


@query("select t, asset_idx, r8(r) as r from panel")
def panel_returns(spark, d):
    return panel(spark, d).select("t", "asset_idx", "r")


@query("select t, asset_idx, r8(diff) as diff from panel")
def panel_rate_diffs(spark, d):
    return panel(spark, d).select("t", "asset_idx", "diff")


@query("select t, r8(x) as x from idx")
def panel_index(spark, d):
    return index(spark, d).select("t", "x")


# ---- windows


_KEPT: dict[tuple, object] = {}


def kept(f):
    """Keeps what ``f`` returns in memory for the session: these tables have a row per day, asset and run."""

    @wraps(f)
    def get(spark, d, *more):
        key = (f.__name__, spark.sparkContext.applicationId, d, *more)
        if key not in _KEPT:
            got = f(spark, d, *more)
            _KEPT[key] = tuple(x.persist() for x in got) if isinstance(got, tuple) else got.persist()
        return _KEPT[key]

    return get


def _r(spark, d):
    return panel(spark, d).select("t", "asset_idx", "r")


def _diffs(spark, d):
    return panel(spark, d).select("t", "asset_idx", "diff")


@query("select t, asset_idx, r8(tr) as trailing from growth where t >= 251")
def trailing_return(spark, d):
    return _r(spark, d).withColumn("trailing", W.trailing_return("r", 252, "asset_idx")).where("trailing is not null").drop("r")


@query("select t, asset_idx, round(1e6::double * var, 8) + 0 as var_e6 from aew where var is not null")
def ewma_variance(spark, d):
    return W.ewma_variance(_r(spark, d), "r", 0.94, 252, "var", "asset_idx").where("var is not null").select("t", "asset_idx", (1e6 * F.col("var")).alias("var_e6"))


@query("select t, r8(vol) as vol from rms")
def rolling_rms_vol(spark, d):
    return index(spark, d).select("t", W.rolling_rms("x", 21, "series_id").alias("vol"))


@query("select t, r8(med) as med from medv")
def expanding_median_vol(spark, d):
    vol = index(spark, d).withColumn("vol", W.rolling_rms("x", 21, "series_id"))
    return W.expanding_median(vol.select("series_id", "t", "vol"), "vol", "med", "series_id").select("t", "med")


@query("select t, r8(case when t >= 1 then x - lag(x) over (order by t) end) as change, r8(sum(x) over (order by t rows unbounded preceding)) as total, r8(max(x) over (order by t rows unbounded preceding)) as top from idx")
def lag_and_running(spark, d):
    x = F.col("x")
    return index(spark, d).select("t", (x - F.lag(x).over(W.over("series_id"))).alias("change"), F.sum(x).over(W.sofar("series_id")).alias("total"), F.max(x).over(W.sofar("series_id")).alias("top"))


# ---- strategies and backtests


def _momentum(spark, d):
    return S.momentum_positions(_r(spark, d), validate=False)


def _carry(spark, d):
    return S.carry_positions(_diffs(spark, d), validate=False)


@kept
def _returns(spark, d):
    a = _r(spark, d).withColumn("run_id", F.lit("momentum"))
    return a.unionByName(S.carry_total_returns(_r(spark, d), _diffs(spark, d)).withColumn("run_id", F.lit("carry")))


@kept
def _positions(spark, d):
    return _momentum(spark, d).withColumn("run_id", F.lit("momentum")).unionByName(_carry(spark, d).withColumn("run_id", F.lit("carry")))


@kept
def _daily(spark, d, run=None):
    pos, ret = _positions(spark, d), _returns(spark, d)
    if run:
        pos, ret = pos.where(F.col("run_id") == run), ret.where(F.col("run_id") == run)
    return B.run_backtest(pos, ret, 5.0, validate=False)


@query("select t, asset_idx, r8(p) as p from mom")
def momentum_positions(spark, d):
    return _momentum(spark, d)


@query("select t, asset_idx, r8(p) as p from car")
def carry_positions(spark, d):
    return _carry(spark, d)


@query("select t, asset_idx, r8(r) as r from ctr")
def carry_total_returns(spark, d):
    return S.carry_total_returns(_r(spark, d), _diffs(spark, d))


@query("select t, r8(gross) as gross, r8(turnover) as turnover, r8(net) as net, r8(equity) as equity from bt where run_id = 'momentum'")
def backtest_daily_momentum(spark, d):
    return _daily(spark, d, "momentum").select("t", "gross", "turnover", "net", "equity")


@query("select t, r8(gross) as gross, r8(turnover) as turnover, r8(net) as net, r8(equity) as equity from bt where run_id = 'carry'")
def backtest_daily_carry(spark, d):
    return _daily(spark, d, "carry").select("t", "gross", "turnover", "net", "equity")


_METRICS = """select run_id, r8(252 * avg(net)) as ann_return, r8(sqrt(252) * stddev_pop(net)) as ann_vol, r8(case when stddev_pop(net) > 0 then sqrt(252) * avg(net) / stddev_pop(net) else 0 end) as sharpe,
    r8(min(drawdown)) as max_dd, r8(case when min(drawdown) <> 0 then 252 * avg(net) / abs(min(drawdown)) else 0 end) as calmar, r8(avg(case when net > 0 then 1 else 0 end)) as hit_rate,
    r8(any_value(worst)) as worst_month from dd join (select run_id, min(r) as worst from {0} group by run_id) using (run_id) group by run_id"""


@query(_METRICS.format("months"))
def metrics_all_runs(spark, d):
    return B.compute_metrics(_daily(spark, d), panel(spark, d).select("t", "date").distinct())


@query("select run_id, t, r8(drawdown) as drawdown from dd")
def drawdown_path(spark, d):
    return B.drawdown(_daily(spark, d)).select("run_id", "t", "drawdown")


@query("select run_id, r8(min(drawdown)) as max_dd from dd group by run_id")
def max_drawdown(spark, d):
    return B.max_drawdown(_daily(spark, d))


@query("select run_id, r8(min(r)) as worst_month from months group by run_id")
def worst_month(spark, d):
    return B.worst_period(_daily(spark, d), panel(spark, d).select("t", "date").distinct())


@query("select run_id, r8(min(r)) as worst_month from blocks group by run_id")
def worst_block21(spark, d):
    return B.worst_period(_daily(spark, d))


@query("select t, r8(0.5::double * sum(net)) as net from net group by t")
def combined_daily(spark, d):
    return S.combined(_daily(spark, d), "book").select("t", "net")


@query("select t, r8(scale) as scale from scale")
def portfolio_scale(spark, d):
    return S.portfolio_scale(S.combined(_daily(spark, d), "book"), first_day=252).select("t", "scale")


@kept
def _book(spark, d):
    p = panel(spark, d)
    return S.scaled_book(p.select("t", "asset_idx", "r"), p.select("t", "asset_idx", "r"), p.select("t", "asset_idx", "diff"), CFG)


@query("select run_id, t, r8(gross) as gross, r8(turnover) as turnover from sflow")
def scaled_book_daily(spark, d):
    pos, ret, _ = _book(spark, d)
    return B.flows(pos, ret)


# ---- gates


@kept
def _states(spark, d):
    """Terciles of the rolling volatility; days before the first window are calm."""
    vol = index(spark, d).withColumn("vol", W.rolling_rms("x", 21, "series_id"))
    cut = vol.agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    s = F.when(F.col("vol").isNull() | (F.col("vol") <= F.col("q")[0]), 0).when(F.col("vol") <= F.col("q")[1], 1).otherwise(2)
    return vol.crossJoin(F.broadcast(cut)).select("series_id", "t", s.alias("state"))  # one row of cuts


@kept
def _vol_gate(spark, d):
    return G.vol_ratio_gate(index(spark, d), FIRST)


@query("select t, r8(gate) as gate from volgate")
def vol_ratio_gate(spark, d):
    return _vol_gate(spark, d).select("t", "gate")


@query("select t, r8(gate) as gate from ewgate")
def ewma_ratio_gate(spark, d):
    return G.ewma_ratio_gate(index(spark, d), FIRST).select("t", "gate")


@query("select t, case when t < 503 then 1 else 0.625 end::double as gate from idx")
def constant_gate(spark, d):
    return G.constant_gate(index(spark, d), 0.625, FIRST).select("t", "gate")


@query("select t, gate from orgate")
def oracle_gate(spark, d):
    return G.oracle_gate(_states(spark, d), FIRST, 2).select("t", "gate")


@query("select t, r8(coalesce(lag(gate, 5) over (order by t), first_value(gate) over (order by t))) as gate from volgate")
def lag_gate(spark, d):
    return G.lag_gate(_vol_gate(spark, d), 5).select("t", "gate")


@query()
def gate_band(spark, d):
    return G.apply_gate_band(_vol_gate(spark, d).withColumn("gate", F.round("gate", 10)), 0.1).select("t", "gate")


@query("select run_id, t, r8(sum(prev * r)) as gross, r8(sum(abs(p - prev))) as turnover from (select *, coalesce(lag(p) over (partition by run_id, asset_idx order by t), 0) as prev from (select run_id, t, asset_idx, p * gate as p from pos join volgate using (t))) join rets using (run_id, t, asset_idx) group by run_id, t")
def apply_gate_backtest(spark, d):
    return B.flows(S.apply_gate(_positions(spark, d), _vol_gate(spark, d).select("t", "gate")), _returns(spark, d))


# ---- evaluation


@kept
def _gate_set(spark, d):
    x = index(spark, d)
    named = lambda df, name: df.select(F.lit(name).alias("series_id"), "t", "gate")
    out = named(x.withColumn("gate", F.lit(1.0)), "unfiltered")
    for name, df in (("vol", _vol_gate(spark, d)), ("ewma", G.ewma_ratio_gate(x, FIRST)), ("oracle", G.oracle_gate(_states(spark, d), FIRST, 2))):
        out = out.unionByName(named(df, name))
    return out


@kept
def _stream(spark, d):
    pos, ret, _ = _book(spark, d)
    return E.build_book(pos, ret, _gate_set(spark, d))


@query("select run_id, t, r8(gross) as gross, r8(turnover) as turnover from book")
def gated_books(spark, d):
    return _stream(spark, d)


_COST = "case when stddev_pop(gross - c / 1e4 * turnover) > 1e-14 then sqrt(252) * avg(gross - c / 1e4 * turnover) / stddev_pop(gross - c / 1e4 * turnover) else 0 end"


@query(f"select run_id, c as cost_bps, r8({_COST}) as sharpe from book, (select unnest([0, 1, 2, 5, 10, 20]::double[]) as c) where t >= {START} group by run_id, c")
def cost_sweep(spark, d):
    return E.cost_sweep(_stream(spark, d), [0, 1, 2, 5, 10, 20], START)


@query(
    f"""select g as run_id, lag, r8({_SHARPE.format("net")}) as sharpe from (
    select g, lag, t, 0.5::double * sum(prev * r) - 0.0005::double * 0.5::double * sum(abs(p - prev)) as net from (
      select *, coalesce(lag(p) over (partition by g, lag, run_id, asset_idx order by t), 0) as prev from (
        select g, lag, run_id, t, asset_idx, p * gate as p from spos join (
          select g, l as lag, t, case l when 0 then gate when 1 then coalesce(lag(gate, 1) over w, first_value(gate) over w) when 2 then coalesce(lag(gate, 2) over w, first_value(gate) over w) else coalesce(lag(gate, 5) over w, first_value(gate) over w) end as gate
          from gset, (select unnest([0, 1, 2, 5]) as l) where g in ('vol', 'ewma') window w as (partition by g, l order by t)) using (t))) join rets using (run_id, t, asset_idx) group by g, lag, t)
    where t >= {START} group by g, lag"""
)
def lag_sweep(spark, d):
    pos, ret, _ = _book(spark, d)
    return E.lag_sweep(pos, ret, _gate_set(spark, d).where("series_id in ('vol', 'ewma')"), [0, 1, 2, 5], 5.0, START)


@query(f"select run_id, r8(1e6::double * avg(gross)) as mg, r8(avg(turnover)) as mt, r8(1e6::double * var_pop(gross)) as vg, r8(1e6::double * covar_pop(gross, turnover)) as cov, r8(var_pop(turnover)) as vt from book where t >= {START} group by run_id")
def break_even_moments(spark, d):
    m = E.moments(_stream(spark, d), START)
    return m.select("run_id", (1e6 * F.col("mg")).alias("mg"), "mt", (1e6 * F.col("vg")).alias("vg"), (1e6 * F.col("cov")).alias("cov"), "vt")


@query()
def break_even(spark, d):
    """Status and cost of the oracle gate against none, by bisection."""
    b = E.gate_break_even(_stream(spark, d), "oracle", "unfiltered", START)
    return spark.createDataFrame([(b.status, b.cost_bps)], "status string, cost_bps double")


@query(f"select run_id, r8(252 * avg(turnover)) as annual_turnover from book where t >= {START} group by run_id")
def annual_turnover(spark, d):
    return E.annual_turnover(_stream(spark, d), START)


@query(
    f"""select run_id, r8(252 * avg(net)) as ann_return, r8(sqrt(252) * stddev_pop(net)) as ann_vol, r8({_SHARPE.format("net")}) as sharpe, r8(min(q)) as max_dd from (
      select run_id, t, net, e / max(e) over (partition by run_id order by t rows unbounded preceding) - 1 as q from (
        select run_id, t, net, product(1 + net) over (partition by run_id order by t rows unbounded preceding) as e from bt where t >= {START})) group by run_id"""
)
def window_metrics(spark, d):
    return E.window_metrics(_daily(spark, d), START).select("run_id", "ann_return", "ann_vol", "sharpe", "max_dd")


@query(
    f"""select run_id, s.state, count(net) as n_days, r8(coalesce(252 * avg(net), 0)) as ann_return, r8(coalesce(sqrt(252) * stddev_pop(net), 0)) as ann_vol, r8({_SHARPE.format("net")}) as sharpe
    from (select distinct run_id from bt) cross join (select unnest([0, 1, 2, 3]) as state) s left join (select run_id, state as st, net from bt join states using (t)) x using (run_id)
    where x.st = s.state group by run_id, s.state union all select run_id, 3, 0, 0, 0, 0 from (select distinct run_id from bt)"""
)
def state_attribution(spark, d):
    return B.state_conditional_returns(_daily(spark, d), _states(spark, d), 4)


@query("select s as state, (select count(*) from states where state = s) as n from (select unnest([0, 1, 2, 3]) as s)")
def state_counts(spark, d):
    return B.bincount(_states(spark, d), 4)


@query("select first_t, end_t from epi")
def episodes(spark, d):
    return G.crisis_episodes(_states(spark, d), START, 2).select("first_t", "end_t")


_AUC = """select {g} r8((sum(case when y then rk end) - count_if(y) * (count_if(y) + 1) / 2.0::double) / (count_if(y) * count_if(not y))) as auc from (
    select *, rank() over ({p} order by s) + (count(*) over (partition by {k} s) - 1) / 2.0::double as rk from ({q})) {e}"""


@query(_AUC.format(g="", p="", k="", e="", q="select quality = 1 as y, n_chars::double as s from labels join documents using (doc_id) where quality is not null"))
def roc_auc(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("label"))
    return E.roc_auc(labels.join(docs, "doc_id"))


_CALL_AUC = """(select (sum(case when y then rk end) - sum(y::int)::double * (sum(y::int) + 1) / 2) / (sum(y::int)::double * sum((not y)::int)) from (
    select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as rk from (select {y} as y, {s} as s from states join volgate using (t) where t >= {t})))"""


@query(
    f"""select n_days, r8({_CALL_AUC.format(y="state = 0", s="gate", t=START)}) as calm_auc, r8({_CALL_AUC.format(y="state = 2", s="-gate", t=START)}) as crisis_auc, r8(acc) as accuracy, r8(greatest(sh, 1 - sh)) as majority_accuracy, episodes, missed, r8(med) as median_lag, r8(mean) as mean_lag from
    (select count(*) as n_days, avg(case when (gate >= 0.5) = (state = 0) then 1 else 0 end) as acc, avg(case when state = 0 then 1 else 0 end) as sh from states join volgate using (t) where t >= {START}),
    (select count(*) as episodes, count_if(lag is null)::bigint as missed, quantile_cont(lag, 0.5) as med, avg(lag) as mean from (
      select first_t, min(v.t) - first_t as lag from epi left join (select t from volgate where gate < 0.5) v on v.t >= first_t and v.t < end_t group by first_t))"""
)
def classification(spark, d):
    got = E.classification_report(_states(spark, d), _vol_gate(spark, d), START)
    return got.select("n_days", "calm_auc", "crisis_auc", "accuracy", "majority_accuracy", "episodes", "missed", F.col("median_lag").cast("double").alias("median_lag"), "mean_lag")


@query(
    """select quality, r8((p + z * z / (2 * n) - h) / (1 + z * z / n)) as low, r8((p + z * z / (2 * n) + h) / (1 + z * z / n)) as high from (
    select *, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) as h from (select quality, avg(toxic)::double as p, count(*)::double as n, 1.96::double as z from labels where quality is not null and toxic is not null group by quality))"""
)
def wilson(spark, d):
    n = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null and toxic is not null").groupBy("quality").agg(F.sum(F.col("toxic").cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return n.select("quality", low.alias("low"), high.alias("high"))


@query("select r8(avg(case when x <= 0 then 1 else 0 end)) as share from idx")
def percentile_of(spark, d):
    return E.percentile_of(index(spark, d), "x", 0.0)


# ---- costs


def _assume():
    return C.CostAssumptions(tuple(1.0 + i for i in range(6)), tuple(5e9 + 1e9 * i for i in range(6)), (0.01,) * 6)


_USD = "(hs / 1e4 * abs(p - prev) * 1e8::double + sg * sqrt(abs(p - prev) * 1e8::double / adv) * abs(p - prev) * 1e8::double)"


@query(f"select run_id, t, asset_idx, round({_USD}, 2) + 0 as cost_usd from strd join assume using (asset_idx)", digits=2)
def trade_cost(spark, d):
    return C.trade_cost(B.trades(_book(spark, d)[0]), 1e8, _assume()).select("run_id", "t", "asset_idx", "cost_usd")


@query(f"select run_id, t, asset_idx, round({_USD}, 2) + 0 as cost_usd from strd join assume using (asset_idx)", digits=2)
def trade_cost_every_day(spark, d):
    return trade_cost(spark, d)


@query(f"select run_id, t, r8(sum{_USD} / 1e8::double) as cost from strd join assume using (asset_idx) group by run_id, t")
def daily_cost_fraction(spark, d):
    return C.daily_cost_fraction(_book(spark, d)[0], 1e8, _assume())


@query("select run_id, t, asset_idx, r8(abs(p - prev) * 1e8::double / adv) as participation from strd join assume using (asset_idx)")
def participation(spark, d):
    return C.participation(_book(spark, d)[0], 1e8, _assume())


@query(
    f"""select run_id, aum, r8({_SHARPE.format("net")}) as sharpe from (
    select run_id, t, aum, sum(prev * r - hs / 1e4 * abs(p - prev) - sqrt(aum) * sg * pow(abs(p - prev), 1.5) / sqrt(adv)) as net
    from strd join rets using (run_id, t, asset_idx) join assume using (asset_idx), (select unnest([1e6, 1e7, 1e8, 1e9, 1e10]::double[]) as aum) group by run_id, t, aum) where t >= {START} group by run_id, aum"""
)
def capacity_curve(spark, d):
    pos, ret, _ = _book(spark, d)
    grid = spark.createDataFrame([(x,) for x in (1e6, 1e7, 1e8, 1e9, 1e10)], "aum double")
    return C.sharpe_at(C.capacity_moments(pos, ret, _assume(), START), grid)


@query(digits=0)
def aum_at_sharpe_fraction(spark, d):
    """Capital at which a run's Sharpe halves; null where it has none to lose."""
    pos, ret, _ = _book(spark, d)
    rows = C.capacity_moments(pos, ret, _assume(), START).collect()  # a row per run
    return spark.createDataFrame([(r["run_id"], C.aum_at_sharpe_fraction(C.sharpe_function(r.asDict()))) for r in rows], "run_id string, aum double")


# ---- model pieces that SQL can say


@query("select t, r8(case when s > 0 then least(greatest(x, m - 3 * 1.4826::double * s), m + 3 * 1.4826::double * s) else x end) as x from idx, (select m, median(abs(x - m)) as s from idx, (select median(x) as m from idx) group by m)")
def winsorize_mad(spark, d):
    return S.winsorize_mad(index(spark, d), "x", 3.0).select("t", "x")


@query("select r8(q[1]) as q1, r8(q[2]) as q2, r8(q[3]) as q3, r8(1e6::double * v) as var_e6 from (select quantile_cont(x, [1 / 6.0::double, 0.5, 5 / 6.0::double]) as q, var_pop(x) as v from idx)")
def quantile_init(spark, d):
    q = F.percentile("x", F.array(F.lit(1 / 6), F.lit(0.5), F.lit(5 / 6)))
    return index(spark, d).agg(q.alias("q"), F.var_pop("x").alias("v")).select(*(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)), (1e6 * F.col("v")).alias("var_e6"))


@query("select k, n_params, r8(ll) as log_likelihood, r8(-2 * ll + 2 * ln(n)) as bic from (select 1 as k, 2 as n_params, -0.5::double * n * (ln(2 * pi() * v) + 1) as ll, n from (select count(*)::double as n, var_pop(x) as v from idx))")
def bic_k1(spark, d):
    return hmm.bic_table(index(spark, d), (1,)).drop("series_id")


@query("select t, r8(-0.5::double * (ln(2 * pi()) + ln(1e-4::double) + pow(x - 0.001, 2) / 1e-4::double)) as calm, r8(-0.5::double * (ln(2 * pi()) + ln(4e-4::double) + pow(x + 0.002, 2) / 4e-4::double)) as crisis from idx")
def emission_logdens(spark, d):
    two = lambda a, b: F.array(F.array(F.lit(a)), F.array(F.lit(b)))
    lb = hmm.emission_log_density(F.array("x"), two(0.001, -0.002), two(1e-4, 4e-4))
    return index(spark, d).select("t", lb.alias("lb")).select("t", F.col("lb")[0].alias("calm"), F.col("lb")[1].alias("crisis"))


# ---- models


def _fits(spark, d, states):
    return hmm.fit_hmm(index(spark, d), states, max_iter=200)


def _fit_rows(fits):
    return fits.select("k", F.posexplode("means").alias("state", "m"), "variances", "log_likelihood", "n_iter", "converged").select(
        "k", "state", F.col("m")[0].alias("mean"), (1e6 * F.col("variances")[F.col("state")][0]).alias("var_e6"), "log_likelihood", "n_iter", "converged"
    )


@query()
def hmm_fit_k2(spark, d):
    return _fit_rows(_fits(spark, d, (2,)))


@query()
def hmm_fit_k3(spark, d):
    return _fit_rows(_fits(spark, d, (3,)))


@query()
def hmm_filtered(spark, d):
    return hmm.filtered_probabilities(index(spark, d), _fits(spark, d, (2,))).select("t", F.posexplode("p").alias("state", "p"))


@query()
def hmm_smoothed(spark, d):
    return hmm.smoothed_probabilities(index(spark, d), _fits(spark, d, (2,))).select("t", F.posexplode("p").alias("state", "p"))


@query()
def hmm_viterbi(spark, d):
    return hmm.decode(index(spark, d), _fits(spark, d, (3,))).select("t", "state")


@query()
def hmm_loglik(spark, d):
    return hmm.log_likelihood(index(spark, d), _fits(spark, d, (2,)))


@query()
def stationary_distribution(spark, d):
    return hmm.stationary_distribution(_fits(spark, d, (3,)))


@query()
def regime_table(spark, d):
    return hmm.regime_table(_fits(spark, d, (3,)))


@query()
def bic_table(spark, d):
    return hmm.bic_table(index(spark, d), (1, 2, 3), max_iter=200)


@query()
def viterbi_accuracy(spark, d):
    fits = _fits(spark, d, (3,)).persist()
    return hmm.viterbi_accuracy(hmm.decode(index(spark, d), fits), _states(spark, d), fits)


def _known(spark):
    """One series with two states of given parameters, whose recursions SQL can say."""
    row = ("index", 2, [0.6, 0.4], [[0.97, 0.03], [0.08, 0.92]], [[0.001], [-0.002]], [[1e-4], [4e-4]])
    return spark.createDataFrame([row], f"series_id string, k int, {hmm.PARAMS}")


@query()
def known_filtered(spark, d):
    return hmm.filtered_probabilities(index(spark, d), _known(spark)).select("t", F.col("p")[0].alias("calm"))


@query()
def known_smoothed(spark, d):
    return hmm.smoothed_probabilities(index(spark, d), _known(spark)).select("t", F.col("p")[0].alias("calm"))


@query()
def known_viterbi(spark, d):
    return hmm.decode(index(spark, d), _known(spark)).select("t", "state")


@query(digits=6)
def known_loglik(spark, d):
    return hmm.log_likelihood(index(spark, d), _known(spark)).select("log_likelihood")


_GATE = {"refit": 252, "max_iter": 100}


@query()
def walk_forward_gate(spark, d):
    return hmm.regime_gate_report(index(spark, d), **_GATE)[0].select("t", "gate", "refit_t")


@query()
def gate_models(spark, d):
    return hmm.regime_gate_report(index(spark, d), **_GATE)[1].select("refit_t", "log_likelihood", "n_iter", "converged", "calm_state", "tripped")


@query()
def calm_guard(spark, d):
    """A crash is put in by hand; refits after it use winsorised returns."""
    shocked = index(spark, d).withColumn("x", F.when(F.col("t") == 1000, -0.3).otherwise(F.col("x")))
    return hmm.regime_gate_report(shocked, calm_guard=0.05, **_GATE)[1].select("refit_t", "calm_state", "tripped")


@query()
def per_asset_regimes(spark, d):
    """Every asset is a series: one model each, side by side."""
    series = panel(spark, d).select(F.col("asset_idx").cast("string").alias("series_id"), "t", F.col("r").alias("x"))
    return hmm.information_criteria(hmm.fit_hmm(series, (2,), max_iter=100)).select("series_id", "k", "log_likelihood", "bic", "n_iter")


@query()
def paired_bootstrap(spark, d):
    """The published 10,000 replicates."""
    net = E.net(_stream(spark, d), 5.0).where(F.col("t") >= START)
    a, b = net.where("run_id = 'vol'").select("t", F.col("net").alias("a")), net.where("run_id = 'unfiltered'").select("t", F.col("net").alias("b"))
    return E.paired_block_bootstrap(a.join(b, "t").withColumn("run_id", F.lit("vol-unfiltered")), n_boot=10_000)


# ---- sources of their own


_RERANK = {"n_days": 63, "switch_days": [0, 10, 42], "diffs": [[0.04, 0.03, 0.02, 0.01], [0.01, 0.02, 0.03, 0.04], [0.02, 0.02, 0.02, 0.02]]}


@query(
    """with v(s, e, a, diff) as (values (0, 10, 0, 0.04), (0, 10, 1, 0.03), (0, 10, 2, 0.02), (0, 10, 3, 0.01), (10, 42, 0, 0.01), (10, 42, 1, 0.02), (10, 42, 2, 0.03), (10, 42, 3, 0.04),
      (42, 63, 0, 0.02), (42, 63, 1, 0.02), (42, 63, 2, 0.02), (42, 63, 3, 0.02)),
    days as (select unnest(range(63))::int as t), k as (select t, a, diff, row_number() over (partition by t order by diff desc, a) as n from days join v on t >= s and t < e)
    select days.t, a as asset_idx, case n when 1 then 1 when 4 then -1 else 0 end::double as p from days join k on k.t = days.t - days.t % 21"""
)
def carry_rerank_golden(spark, d):
    return S.carry_positions(dataset.rerank_panel(spark, **_RERANK), 1, 1, 21)


@query()
def carry_rerank_rows(spark, d):
    return golden.carry_rerank_rows(spark)


@query()
def full_study(spark, d):
    """The whole study of the path of seed 19: likelihoods, counts, metrics, turnover and accuracy as rows."""
    return golden.study_rows(dgp.dataset(spark, _STUDY))


@query()
def synthetic_paths(spark, d):
    """Per scenario and seed: days in each state and the index's yearly moments."""
    rows = dgp.paths(spark, range(1, 5), dgp.SCENARIOS, 500)
    wide = rows.where("table in ('states', 'index')").groupBy("scenario", "seed", "t").pivot("table", ["states", "index"]).agg(F.first("value"))
    return wide.groupBy("scenario", "seed").agg(F.sum((F.col("states") == 2).cast("int")).alias("crisis_days"), (252 * F.avg("index")).alias("ann_mean"), F.stddev_pop("index").alias("sd"))


@query()
def seed_sweep(spark, d):
    """Index Sharpe with and without the volatility gate on every path, all paths in one query."""
    x = dgp.paths(spark, range(1, 11), dgp.SCENARIOS, 700).where("table = 'index'").select(F.concat_ws(":", "scenario", "seed").alias("series_id"), "t", F.col("value").alias("x"))
    gate = G.vol_ratio_gate(x, 252)
    held = x.join(gate, ["series_id", "t"]).withColumn("g", W.lag_or("gate", 1.0, "series_id")).where("t >= 253")
    s = lambda v: B.sharpe_of(F.avg(v), F.stddev_pop(v))
    each = held.groupBy("series_id").agg(s(F.col("x")).alias("unfiltered"), s(F.col("x") * F.col("g")).alias("vol"))
    rows = each.select(F.split("series_id", ":")[0].alias("scenario"), "unfiltered", "vol", F.lit(None).cast("string").alias("error"))
    return E.summarise_paths(rows, ("vol", "unfiltered"))


#: The published settings of a path's evaluation.
_STUDY = CFG | {"n_states": 3, "em_tol": 1e-8, "em_max_iter": 500, "var_floor": 1e-8, "refit_days": 63, "gate_mode": "prob", "gate_threshold": 0.5}


@query()
def path_evaluation(spark, d):
    """Every gate on one seed of every scenario, at the published settings."""
    return study.evaluate_paths(dgp.paths(spark, [1], dgp.SCENARIOS, decimals=10), _STUDY)


@query()
def path_summary(spark, d):
    """Per scenario over two seeds; any number of seeds is the same plan."""
    return study.summarise(study.evaluate_paths(dgp.paths(spark, [1, 2], dgp.SCENARIOS, decimals=10), _STUDY))


@query()
def band_summary(spark, d):
    return study.summarise_bands(study.band_sweep(dgp.paths(spark, [1], dgp.SCENARIOS, decimals=10), _STUDY))


@query()
def capacity_sensitivity(spark, d):
    """Capital at which the whole book's Sharpe halves, impact and volumes scaled; dollars."""
    weights, returns = study.capacity_book(dgp.paths(spark, [19], ["base"], decimals=10), _STUDY)
    a = study.capacity_assumptions(returns.where("run_id = 'base:19|unfiltered'"), 6, START)
    return C.half_sharpe_sensitivity(C.capacity_moments(weights, returns, a, START))


@query()
def select_seed(spark, d):
    x = dgp.paths(spark, range(1, 12), ("base",), 400).where("table = 'index'")
    return dgp.select_seed(x.groupBy("seed").agg(B.sharpe_of(F.avg("value"), F.stddev_pop("value")).alias("sharpe")))


# ---- streaming


@query()
def stream_filter(spark, d):
    """Posterior of a two-state filter over the event stream, an event type a series: every type's last one, and how many rows gave an error."""
    params = hmm_kernel.HMMParams(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[20.0], [80.0]]), np.array([[900.0], [2500.0]]))
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = events.select(F.col("event_type").alias("series_id"), F.col("event_id").alias("seq"), F.array("value").alias("x"), F.lit("x").alias("op"))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp()}"
    at = f"{base}/regime-filter-{uuid.uuid4().hex}"
    out = regime_filter.filter_stream(rows, params)
    run = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(regime_filter.OUTPUT).parquet(f"{at}/rows")
    last = got.where("error is null").groupBy("series_id").agg(F.max_by("alpha", "seq").alias("alpha"), F.max("seq").alias("seq"))
    errors = got.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("error").isNotNull().cast("int")).alias("n_errors"))
    return errors.join(last, "series_id").select("series_id", "n", "n_errors", "seq", F.col("alpha")[0].alias("p0"))


@query("select time_bucket(interval 1 day, ts)::timestamp as day, event_type, count(*) as n, r8(avg(value)) as mean from events group by 1, 2")
def daily_events(spark, d):
    """Events to daily values, the window that feeds a filter."""
    e = spark.read.parquet(f"{d}/events.parquet")
    got = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return got.select(F.col("w.start").alias("day"), "event_type", "n", "mean")


def _recursive(select: str, name: str, *rest: str) -> str:
    """SQL with ``select`` over the named tables kept as ``name``, then further tables, which may be recursive; the last of ``rest`` is the final select."""
    tables, _, last = _sql(select).rpartition("\nselect ")
    more = "".join(f",\n{x}" for x in rest[:-1])
    return f"with recursive {tables.removeprefix('with ')},\n{name} as materialized (select {last}){more}\n{rest[-1]}"


def _density(mean: str, var: str) -> str:
    return f"exp(-0.5::double * (ln(2 * pi()) + ln({var}::double) + pow(x - ({mean}), 2) / {var}::double))"


_EMIT = f"select t, {_density('0.001', '1e-4')} as b0, {_density('-0.002', '4e-4')} as b1 from idx"
_FORWARD = """fw(t, c, a0, a1) as (
    select t, 0.6 * b0 + 0.4 * b1, 0.6 * b0 / (0.6 * b0 + 0.4 * b1), 0.4 * b1 / (0.6 * b0 + 0.4 * b1) from em where t = 0
    union all select t, u0 + u1, u0 / (u0 + u1), u1 / (u0 + u1) from (select em.t, (0.97 * a0 + 0.08 * a1) * b0 as u0, (0.03 * a0 + 0.92 * a1) * b1 as u1 from fw join em on em.t = fw.t + 1))"""
_BACKWARD = """bw(t, v0, v1) as (
    select max(t), 1::double, 1::double from em
    union all select t, u0 / (u0 + u1), u1 / (u0 + u1) from (select bw.t - 1 as t, 0.97 * b0 * v0 + 0.03 * b1 * v1 as u0, 0.08 * b0 * v0 + 0.92 * b1 * v1 as u1 from bw join em on em.t = bw.t where bw.t > 0))"""
_BEST = """best(t, m0, m1, f0, f1) as (
    select t, ln(0.6::double) + ln(b0), ln(0.4::double) + ln(b1), 0, 0 from em where t = 0
    union all select em.t, greatest(m0 + ln(0.97::double), m1 + ln(0.08::double)) + ln(b0), greatest(m0 + ln(0.03::double), m1 + ln(0.92::double)) + ln(b1),
      case when m0 + ln(0.97::double) >= m1 + ln(0.08::double) then 0 else 1 end, case when m0 + ln(0.03::double) >= m1 + ln(0.92::double) then 0 else 1 end from best join em on em.t = best.t + 1),
    path(t, state) as (
    select t, case when m0 >= m1 then 0 else 1 end from best where t = (select max(t) from em)
    union all select path.t - 1, case when path.state = 0 then f0 else f1 end from path join best on best.t = path.t where path.t > 0)"""
_SQL["known_filtered"] = _recursive(_EMIT, "em", _FORWARD, "select t, round(a0, 8) + 0 as calm from fw")
_SQL["known_loglik"] = _recursive(_EMIT, "em", _FORWARD, "select round(sum(ln(c)), 6) + 0 as log_likelihood from fw")
_SQL["known_smoothed"] = _recursive(_EMIT, "em", _FORWARD, _BACKWARD, "select t, round(a0 * v0 / (a0 * v0 + a1 * v1), 8) + 0 as calm from fw join bw using (t)")
_SQL["known_viterbi"] = _recursive(_EMIT, "em", _BEST, "select t, state from path")

_AT = "(case when {m}.vg - 2 * ({c}) * {m}.cov + ({c}) * ({c}) * {m}.vt > 0 then sqrt(252) * ({m}.mg - ({c}) * {m}.mt) / sqrt({m}.vg - 2 * ({c}) * {m}.cov + ({c}) * ({c}) * {m}.vt) else 0 end)"
_EDGE = lambda c: f"({_AT.format(m='a', c=c)} - {_AT.format(m='u', c=c)})"
_SQL["break_even"] = _recursive(
    f"select run_id, avg(gross) as mg, avg(turnover) as mt, var_pop(gross) as vg, covar_pop(gross, turnover) as cov, var_pop(turnover) as vt from book where t >= {START} group by run_id",
    "m",
    "a as (select * from m where run_id = 'oracle'), u as (select * from m where run_id = 'unfiltered')",
    f"""halved(low, high) as (select 0::double, 100::double union all
    select case when {_EDGE("0.5 * (low + high) / 1e4")} > 0 then 0.5 * (low + high) else low end, case when {_EDGE("0.5 * (low + high) / 1e4")} > 0 then high else 0.5 * (low + high) end from halved, a, u where high - low > 1e-4)""",
    f"""select case when not {_EDGE("0::double")} > 0 then 'below_at_zero' when {_EDGE("0.01::double")} > 0 then 'above_at_max' else 'crossed' end as status,
    case when {_EDGE("0::double")} > 0 and not {_EDGE("0.01::double")} > 0 then round(0.5 * (low + high), 8) + 0 else 'nan'::double end as cost_bps from (select * from halved order by high - low limit 1), a, u""",
)
_SQL["gate_band"] = _recursive(
    "select t, round(gate, 10) as gate from volgate", "rg",
    "walk(t, o) as (select -1, 1::double union all select w.t + 1, case when abs(g.gate - w.o) > 0.1::double then g.gate else w.o end from walk w join rg g on g.t = w.t + 1)",
    "select t, round(o, 8) + 0 as gate from walk where t >= 0",
)
_NET_AT = lambda x: f"(m_g - m_s - ({x}) * m_i)"
_VAR_AT = lambda x: f"greatest(c_gg + c_ss + ({x}) * ({x}) * c_ii - 2 * c_gs - 2 * ({x}) * c_gi + 2 * ({x}) * c_si, 0)"
_SHARPE_AT = lambda aum: f"(case when {_VAR_AT(f'sqrt({aum})')} > 0 then sqrt(252) * {_NET_AT(f'sqrt({aum})')} / sqrt({_VAR_AT(f'sqrt({aum})')}) else 0 end)"
_SQL["aum_at_sharpe_fraction"] = _recursive(
    f"""select run_id, avg(g) as m_g, avg(s) as m_s, avg(i) as m_i, var_pop(g) as c_gg, var_pop(s) as c_ss, var_pop(i) as c_ii, covar_pop(g, s) as c_gs, covar_pop(g, i) as c_gi, covar_pop(s, i) as c_si from (
    select run_id, t, sum(prev * r) as g, sum(hs / 1e4 * abs(p - prev)) as s, sum(sg * pow(abs(p - prev), 1.5) / sqrt(adv)) as i
    from strd join rets using (run_id, t, asset_idx) join assume using (asset_idx) where t >= {START} group by run_id, t) group by run_id""",
    "m",
    f"base as (select *, {_SHARPE_AT('1e6::double')} as s0 from m)",
    f"grid as (select run_id, i, 1e6::double * pow(1e6::double, i / 40.0::double) as aum, {_SHARPE_AT('1e6::double * pow(1e6::double, i / 40.0::double)')} as sh from m, (select unnest(range(41)) as i))",
    "hit as (select run_id, min(i) as i from grid join base using (run_id) where s0 > 0 and sh <= 0.5::double * s0 group by run_id)",
    "ends as (select hit.run_id, lo.aum as a, hi.aum as b from hit join grid lo on lo.run_id = hit.run_id and lo.i = greatest(hit.i - 1, 0) join grid hi on hi.run_id = hit.run_id and hi.i = hit.i)",
    f"""cut(run_id, a, b) as (select * from ends union all
    select run_id, case when {_SHARPE_AT('sqrt(a * b)')} <= 0.5::double * s0 then a else sqrt(a * b) end, case when {_SHARPE_AT('sqrt(a * b)')} <= 0.5::double * s0 then sqrt(a * b) else b end from cut join base using (run_id) where b / a - 1 > 1e-4::double)""",
    "select m.run_id, round(min(b), 0) + 0 as aum from m left join cut using (run_id) group by m.run_id",
)
_EVENT = lambda mean, var: f"exp(-0.5::double * (ln(2 * pi()) + ln({var}::double) + pow(value - {mean}, 2) / {var}::double))"
_SQL["stream_filter"] = f"""with e as (select event_type as series_id, event_id as seq, {_EVENT(20, 900)} as b0, {_EVENT(80, 2500)} as b1 from events),
    s as (select series_id, count(*) as n, max(seq) as seq, list({{'b0': b0, 'b1': b1}} order by seq) as y from e group by series_id),
    r as (select series_id, n, seq, list_reduce(list_prepend({{'b0': y[1].b0, 'b1': y[1].b1}}, y[2:]), lambda a, b: {{
      'b0': (0.95 * a.b0 / (a.b0 + a.b1) + 0.1 * a.b1 / (a.b0 + a.b1)) * b.b0, 'b1': (0.05 * a.b0 / (a.b0 + a.b1) + 0.9 * a.b1 / (a.b0 + a.b1)) * b.b1}}) as z from s)
    select series_id, n, 0::bigint as n_errors, seq, round(z.b0 / (z.b0 + z.b1), 8) + 0 as p0 from r"""
_UNIT = lambda at: "((" + " + ".join(f"(instr('0123456789abcdef', substr(h, {at + i}, 1)) - 1) * {16 ** (7 - i)}::bigint" for i in range(8)) + ")::double / 4294967296)"
_SPREAD = lambda m: f"(case when {m}{m} - {m} * {m} > 0 then sqrt(252) * {m} / sqrt({m}{m} - {m} * {m}) else 0 end)"
_SQL["paired_bootstrap"] = _recursive(
    f"""select row_number() over (order by v.t) as pos, v.gross - 0.0005::double * v.turnover as x, u.gross - 0.0005::double * u.turnover as y
    from book v join book u on v.t = u.t and v.run_id = 'vol' and u.run_id = 'unfiltered' where v.t >= {START}""",
    "day",
    """sums as materialized (select pos, sum(x) over w as a, sum(y) over w as b, sum(x * x) over w as aa, sum(y * y) over w as bb from day window w as (order by pos rows unbounded preceding))""",
    """drawn as (select *, md5('83:' || rep || ':' || blk) as h from (select rep, n, most, unnest(range(most)) as blk from (
      select n, least(n, ceil(n / 21.0::double + 6 * sqrt(n / 21.0::double) + 10)::bigint) as most, unnest(range(10000)) as rep from (select count(*) as n from day))))""",
    f"""lens as (select rep, blk, n, floor({_UNIT(1)} * n)::bigint as start, case when blk = most - 1 then n else least(1 + floor(ln(1 - {_UNIT(9)}) / ln(1 - 1 / 21.0::double))::bigint, n) end as len from drawn)""",
    "done as (select *, coalesce(sum(len) over (partition by rep order by blk rows between unbounded preceding and 1 preceding), 0)::bigint as done from lens)",
    "marks as (select rep, n, unnest([start, least(start + least(len, n - done), n), start + least(len, n - done) - n]) as pos, unnest([-1, 1, 1]) as sign from done where done < n)",
    "boot as (select rep, sum(sign * a) / n as a, sum(sign * b) / n as b, sum(sign * aa) / n as aa, sum(sign * bb) / n as bb from marks join sums using (pos) group by rep, n)",
    f"""select 'vol-unfiltered' as run_id, round(any_value(point), 8) + 0 as diff, round(quantile_cont(d, 0.025), 8) + 0 as low, round(quantile_cont(d, 0.975), 8) + 0 as high, round(stddev_samp(d), 8) + 0 as std_error,
      round(avg((d > 0)::int), 8) + 0 as p_positive, count(*) as n_boot from (select {_SPREAD("a")} - {_SPREAD("b")} as d from boot),
      (select {_SHARPE.format("x")} - {_SHARPE.format("y")} as point from day)""",
)


# ---- slices by date


@query(
    f"""select run_id, period, count(*) as n_days, r8({_SHARPE.format("net")}) as sharpe from (select run_id, gross - 0.0005::double * turnover as net, year(d) as y from book join days using (t)),
    (select 'first' as period, 1992 as a, 1994 as b union all select 'middle', 1994, 1996 union all select 'last', 1997, 2100) where y between a and b group by 1, 2"""
)
def sharpe_by_period(spark, d):
    """Sharpe of the gated books in slices of years, which may overlap."""
    return market_study.sharpe_by_period(E.net(_stream(spark, d), 5.0), panel(spark, d).select("t", "date").distinct(), (("first", 1992, 1994), ("middle", 1994, 1996), ("last", 1997, 2100)))


@query(
    """select strftime(d, '%Y-%m-%d') as date, r8(x) as x, r8(o.total) as total from idx join days using (t) join (select cast(o_orderdate as date) as d, sum(o_totalprice)::double as total from orders group by 1) o using (d)
    where d >= date '1995-03-01'"""
)
def index_with_orders(spark, d):
    """The index next to the value of the orders of its days, from a first day on; days that only one has drop out."""
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").cast("double").alias("total"))
    x = index(spark, d).join(panel(spark, d).select("t", "date").distinct(), "t").select("date", "x")
    return market_study.joined_since(x, orders, "1995-03-01").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "x", "total")


# ---- rules that ride along


@query("select run_id, t, r8(net) as net, r8(equity) as equity from bt")
def saved_backtest(spark, d):
    """The backtest of both sleeves, written with its input rules checked in the same job."""
    return B.save_backtest(_positions(spark, d), _returns(spark, d), scratch.new_path(spark, "backtest"), 5.0).select("run_id", "t", "net", "equity")
