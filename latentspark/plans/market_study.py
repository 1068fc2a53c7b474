"""The study of a market with real history: gates on a broad index and on momentum over its industries.

Two dated text tables, the factors (market excess return, risk-free rate) and the
industries, are joined on their dates from a first day on. The model watches the market's
total return; books trade excess returns. Six gates on two books are one plan keyed by
run: figures of the window, bootstraps of pairs of gates, and Sharpe ratios by period of years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentspark.operators import evaluation as E
from latentspark.operators import gates as G
from latentspark.operators import hmm
from latentspark.operators import strategies as S
from latentspark.operators.backtest import run_backtest, sharpe_of
from latentspark.plans.pipeline import gate_settings
from latentspark.sources.dataset import read_dated_text

#: The first day, the periods of years, and the pairs of gates whose difference is bootstrapped.
SINCE = "1963-07-01"
PERIODS = (("1965-1984", 1965, 1984), ("1985-2004", 1985, 2004), ("2005-end", 2005, 2100))
PAIRS = (("hmm", "unfiltered"), ("hmm", "vol"), ("hmm", "constant"), ("hmm_band", "vol"))


def joined_since(left: DataFrame, right: DataFrame, since: str | Column, date: str = "date") -> DataFrame:
    """Rows of both tables with one date, from ``since`` on; dates that only one has drop out."""
    return left.join(right, date).where(F.col(date) >= (F.lit(since).cast("date") if isinstance(since, str) else since))


def numbered_days(rows: DataFrame, date: str = "date") -> DataFrame:
    """Adds ``t``, the day's position; a table of a row per day."""
    return rows.withColumn("t", F.row_number().over(Window.orderBy(date)) - 1)


def sharpe_by_period(daily: DataFrame, dates: DataFrame, periods: Sequence[tuple[str, int, int]] = PERIODS) -> DataFrame:
    """(run_id, period, n_days, sharpe): ``net`` of (run_id, t, net) sliced by the years of (t, date), both ends included.

    A day may lie in several periods or none; a run without days in a period has no row there."""
    spans = F.explode(F.array(*(F.struct(F.lit(n).alias("period"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in periods))).alias("s")
    rows = daily.join(dates.select("t", F.year("date").alias("y")), "t").select("run_id", "net", "y", spans).where(F.col("y").between(F.col("s.a"), F.col("s.b")))
    return rows.groupBy("run_id", F.col("s.period").alias("period")).agg(F.count("*").alias("n_days"), sharpe_of(F.avg("net"), F.stddev_pop("net")).alias("sharpe"))


def load_market(spark: SparkSession, factors: str, industries: str, names: Sequence[str], since: str = SINCE) -> tuple[DataFrame, DataFrame]:
    """(t, date, excess, rf) and (t, asset_idx, r): the market and its industries in excess of the risk-free rate.

    ``factors`` has excess return, two more factors and the risk-free rate; ``industries`` a column for each of ``names``."""
    ff = read_dated_text(spark, factors, ["excess", "smb", "hml", "rf"]).select("date", "excess", "rf")
    ind = read_dated_text(spark, industries, list(names))
    rows = numbered_days(joined_since(ff, ind, since)).persist()  # a row per day
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("asset_idx"), (F.col(n) - F.col("rf")).alias("r")) for i, n in enumerate(names)))).alias("v")
    return rows.select("t", "date", "excess", "rf"), rows.select("t", each).select("t", "v.asset_idx", "v.r")


def gate_table(market: DataFrame, cfg: dict) -> DataFrame:
    """(gate_id, t, gate): none, the model's, the model's in a band of 0.3, a constant at the model's mean level, and both volatility rules."""
    start = cfg["train_min_days"]
    series = market.select(F.lit("index").alias("series_id"), "t", (F.col("excess") + F.col("rf")).alias("x"))
    model = hmm.regime_gate(series, **gate_settings(cfg)).persist()  # a row per day
    last = series.agg(F.max("t")).first()[0]
    level = model.where((F.col("t") >= start - 1) & (F.col("t") < last)).agg(F.avg("gate")).first()[0]
    each = {
        "unfiltered": series.withColumn("gate", F.lit(1.0)), "hmm": model, "hmm_band": G.apply_gate_band(model, 0.3), "constant": G.constant_gate(series, level, start - 1),
        "vol": G.vol_ratio_gate(series, start - 1), "ewma": G.ewma_ratio_gate(series, start - 1, cfg["ewma_lambda"]),
    }
    out = None
    for name, df in each.items():
        one = df.select(F.lit(name).alias("gate_id"), "t", "gate")
        out = one if out is None else out.unionByName(one)
    return out


def study(market: DataFrame, industries: DataFrame, cfg: dict, n_boot: int = 2_000, mean_block: float = 21.0) -> dict[str, DataFrame]:
    """Result tables by name: metrics, turnover, bootstrap and periods of the runs ``book|gate``."""
    start = cfg["train_min_days"]
    gates = gate_table(market, cfg).persist()
    momentum = S.momentum_positions(industries, cfg["momentum_lookback"], cfg["vol_target"], cfg["ewma_lambda"], cfg["leverage_cap"])
    held = market.select(F.lit("market").alias("book"), "t", F.lit(0).alias("asset_idx"), F.lit(1.0).alias("p")).unionByName(momentum.select(F.lit("momentum").alias("book"), "t", "asset_idx", "p"))
    returns = market.select(F.lit("market").alias("book"), "t", F.lit(0).alias("asset_idx"), F.col("excess").alias("r")).unionByName(industries.select(F.lit("momentum").alias("book"), "t", "asset_idx", "r"))
    run = F.concat_ws("|", "book", "gate_id").alias("run_id")
    positions = held.join(gates, "t").select(run, "t", "asset_idx", (F.col("p") * F.col("gate")).alias("p"))
    rets = returns.join(F.broadcast(gates.select("gate_id").distinct()), how="cross").select(run, "t", "asset_idx", "r")
    daily = run_backtest(positions, rets, cfg["cost_bps"]).persist()
    dates = market.select("t", "date")
    late = daily.where(F.col("t") >= start).select("run_id", "t", "net").withColumns({"book": F.split("run_id", r"\|")[0], "gate_id": F.split("run_id", r"\|")[1]})
    side = lambda g, name: late.where(F.col("gate_id") == g).select("book", "t", F.col("net").alias(name))
    pairs = None
    for a, b in PAIRS:
        one = side(a, "a").join(side(b, "b"), ["book", "t"]).select(F.concat_ws("|", "book", F.lit(f"{a}-{b}")).alias("run_id"), "t", "a", "b")
        pairs = one if pairs is None else pairs.unionByName(one)
    return {
        "daily": daily, "metrics": E.window_metrics(daily, start, dates), "turnover": E.annual_turnover(daily, start),
        "bootstrap": E.paired_block_bootstrap(pairs, n_boot, mean_block), "periods": sharpe_by_period(daily, dates),
    }
