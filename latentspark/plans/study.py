"""Studies over many simulated paths, all paths in one plan.

A path is a (scenario, seed); it is part of every key, so books, gates and
measures of all paths are the same windows, joins and aggregates. A path whose
model can't be fitted is a row with an ``error``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators import costs as C
from latentspark.operators import evaluation as E
from latentspark.operators import gates as G
from latentspark.operators import hmm_kernel
from latentspark.operators import strategies as S
from latentspark.operators.backtest import flows
from latentspark.plans.pipeline import gate_settings

PATH = ("path",)
BANDS = (0.0, 0.1, 0.2, 0.3, 0.5)
AUM_GRID = (1e6, 3e6, 1e7, 3e7, 1e8, 3e8, 1e9, 3e9, 1e10)
#: Fixed values, illustrative and not calibrated: half spreads (bps) and daily volumes (dollars) of trend instruments and of currencies.
TREND_COST, FX_COST = (1.0, 5e9), (0.5, 2e10)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of ``dgp.paths`` with their path as one column."""
    return rows.select(F.concat_ws(":", "scenario", "seed").alias("path"), "table", "t", "asset_idx", "value")


def _table(rows: DataFrame, name: str, value: str) -> DataFrame:
    return rows.where(F.col("table") == name).select("path", "t", "asset_idx", F.col("value").alias(value))


def books(rows: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(positions, returns) of both sleeves of every path, scaled to the portfolio's target: (path, run_id, t, asset_idx, p or r)."""
    trend, spot, diffs = _table(rows, "trend", "r"), _table(rows, "spot", "r"), _table(rows, "diff", "diff")
    sleeve = lambda df, name: df.withColumn("run_id", F.lit(name))
    momentum = S.momentum_positions(trend, cfg["momentum_lookback"], cfg["vol_target"], cfg["ewma_lambda"], cfg["leverage_cap"], validate=False, keys=PATH)
    carry = S.carry_positions(diffs, cfg["carry_top_n"], cfg["carry_bottom_n"], cfg["rebalance_days"], validate=False, keys=PATH)
    raw = sleeve(momentum, "momentum").unionByName(sleeve(carry, "carry"))
    returns = sleeve(trend, "momentum").unionByName(sleeve(S.carry_total_returns(spot, diffs, PATH), "carry"))
    one = lambda df: df.withColumn("run_id", F.concat_ws("|", "path", "run_id"))
    net = flows(one(raw), one(returns)).withColumn("net", F.col("gross") - cfg["cost_bps"] / 1e4 * F.col("turnover"))
    book = net.groupBy(F.split("run_id", r"\|")[0].alias("run_id"), "t").agg((0.5 * F.sum("net")).alias("net"))
    scale = S.portfolio_scale(book, cfg["portfolio_vol_target"], cfg["ewma_lambda"], cfg["leverage_cap"], cfg["momentum_lookback"]).withColumnRenamed("run_id", "path")
    positions = raw.join(scale, ["path", "t"]).select("path", "run_id", "t", "asset_idx", (F.col("p") * F.col("scale")).alias("p"))
    return positions, returns


def model_gates(series: DataFrame, cfg: dict) -> DataFrame:
    """(path, t, gate, error) of the walk-forward model on (path, t, x); a path that can't be fitted has one row, with its error."""
    settings = gate_settings(cfg)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        try:
            gate = hmm_kernel.walk_forward(pdf["x"].to_numpy(dtype=float), **settings).gate
        except ValueError as e:
            return pd.DataFrame({"path": pdf["path"].iloc[:1], "t": [None], "gate": [None], "error": [str(e)]})
        return pd.DataFrame({"path": pdf["path"].to_numpy(), "t": pdf["t"].to_numpy(), "gate": gate, "error": None})

    return series.select("path", "t", "x").groupBy("path").applyInPandas(walk, "path string, t int, gate double, error string")


def all_gates(rows: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(path, series_id = gate's name, t, gate) of all six gates, and (path, error) of the paths that failed."""
    start = cfg["train_min_days"]
    first = start - 1
    series = _table(rows, "index", "x").drop("asset_idx")
    states = _table(rows, "states", "state").withColumn("state", F.col("state").cast("int")).drop("asset_idx")
    found = model_gates(series, cfg).persist()  # a row per path and day
    failed = found.where("error is not null").select("path", "error")
    model = found.where("error is null").select("path", "t", "gate")
    last = series.groupBy("path").agg(F.max("t").alias("last"))
    level = model.join(last, "path").where((F.col("t") >= first) & (F.col("t") < F.col("last"))).groupBy("path").agg(F.avg("gate").alias("level"))
    constant = series.join(level, "path").select("path", "t", F.when(F.col("t") < first, 1.0).otherwise(F.col("level")).alias("gate"))
    each = {
        "unfiltered": series.select("path", "t", F.lit(1.0).alias("gate")), "hmm": model, "constant": constant, "vol": G.vol_ratio_gate(series, first, key="path"),
        "ewma": G.ewma_ratio_gate(series, first, cfg["ewma_lambda"], key="path"), "oracle": G.oracle_gate(states, first, 2, key="path"),
    }
    out = None
    for name, df in each.items():
        df = df.select("path", F.lit(name).alias("series_id"), "t", "gate")
        out = df if out is None else out.unionByName(df)
    return out.join(failed.select("path"), "path", "left_anti"), failed


def _scenario() -> list:
    part = F.split("path", ":")
    return [part[0].alias("scenario"), part[1].cast("int").alias("seed")]


def evaluate_paths(rows: DataFrame, cfg: dict) -> DataFrame:
    """One row per path: Sharpe of the book under every gate from the window's
    start on, the model's edge over the others, the edge without costs and over
    all days, its break-even cost, and how well its calls match the true states.
    ``rows`` are those of ``dgp.paths``."""
    rows, start = keyed(rows), cfg["train_min_days"]
    gates, failed = all_gates(rows, cfg)
    stream = E.build_book(*books(rows, cfg), gates, PATH).withColumn("run_id", F.concat_ws("|", "path", "run_id")).persist()
    cost = lambda bps: E.sharpe_at_cost(F.lit(bps / 1e4))
    own, named = F.split("run_id", r"\|")[0].alias("path"), F.split("run_id", r"\|")[1].alias("gate")
    moments = F.struct("mg", "mt", "vg", "cov", "vt")
    window = E.moments(stream, start).select(own, named, cost(cfg["cost_bps"]).alias("s"), cost(0.0).alias("s0"), moments.alias("m"))
    whole = E.moments(stream).select(own, named, cost(cfg["cost_bps"]).alias("s"))
    pick = lambda c, g: F.first(F.when(F.col("gate") == g, F.col(c)), True)
    names = ("unfiltered", "hmm", "constant", "vol", "ewma", "oracle")
    wide = window.groupBy("path").agg(
        *(pick("s", g).alias(g) for g in names), (pick("s0", "hmm") - pick("s0", "unfiltered")).alias("d_zero_cost"), pick("m", "hmm").alias("m_hmm"), pick("m", "unfiltered").alias("m_unfiltered")
    )
    wide = E.break_even(wide, "m_hmm", "m_unfiltered").withColumn("break_even", F.when(~F.isnan("break_even"), F.col("break_even")))
    full = whole.groupBy("path").agg((pick("s", "hmm") - pick("s", "unfiltered")).alias("d_full_sample"))
    states = _table(rows, "states", "state").withColumn("state", F.col("state").cast("int")).drop("asset_idx")
    said = E.classification_report(states, gates.where("series_id = 'hmm'").drop("series_id"), start, cfg["gate_threshold"], key="path")
    edges = [(F.col("hmm") - F.col(g)).alias(f"d_{g}") for g in ("unfiltered", "vol", "ewma")] + [(F.col("oracle") - F.col("unfiltered")).alias("d_oracle")]
    got = wide.select("*", *edges).join(full, "path").join(said.select("path", "accuracy", "majority_accuracy", "calm_auc", "crisis_auc", "episodes", "missed"), "path")
    return got.join(failed, "path", "full").select(*_scenario(), "*").drop("path")


def summarise(paths: DataFrame) -> DataFrame:
    """Per scenario of :func:`evaluate_paths`: what :func:`E.summarise_paths` gives, the median break-even cost of the paths that have one, and how many don't."""
    base = E.summarise_paths(paths, ("hmm", "unfiltered"), ("hmm", "vol"), ("hmm", "ewma"), ("oracle", "unfiltered"))
    status = lambda s: F.count_if(F.col("break_even_status") == s).alias(s)
    return base.join(paths.groupBy("scenario").agg(F.percentile("break_even", F.lit(0.5)).alias("median_break_even"), status("crossed"), status("below_at_zero"), status("above_at_max")), "scenario")


def band_sweep(rows: DataFrame, cfg: dict, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(scenario, seed, gate, band, sharpe, turnover) of the model's gate and the
    volatility rule under every no-trade band; the gates are made once a path."""
    rows, start = keyed(rows), cfg["train_min_days"]
    gates, _ = all_gates(rows, cfg)
    plain = gates.where("series_id in ('hmm', 'vol')").select(F.concat_ws("|", "path", "series_id").alias("series_id"), "t", "gate").persist()
    banded = None
    for band in bands:
        one = G.apply_gate_band(plain, band).select(F.split("series_id", r"\|")[0].alias("path"), F.concat_ws("@", F.split("series_id", r"\|")[1], F.lit(str(band))).alias("series_id"), "t", "gate")
        banded = one if banded is None else banded.unionByName(one)
    banded = banded.unionByName(gates.where("series_id = 'unfiltered'").withColumn("series_id", F.lit("unfiltered@0.0")))
    stream = E.net(E.build_book(*books(rows, cfg), banded, PATH), cfg["cost_bps"]).where(F.col("t") >= start).withColumn("run_id", F.concat_ws("|", "path", "run_id"))
    got = E.sharpe(stream).join(E.annual_turnover(stream), "run_id").withColumn("path", F.split("run_id", r"\|")[0])
    name = F.split(F.split("run_id", r"\|")[1], "@")
    return got.select(*_scenario(), name[0].alias("gate"), name[1].cast("double").alias("band"), "sharpe", "annual_turnover")


def summarise_bands(swept: DataFrame) -> DataFrame:
    """(scenario, band): mean Sharpe and turnover of the banded model gate, and its
    share of wins and mean edge over the unfiltered book and the volatility rule under the same band."""
    of = lambda g: swept.where(F.col("gate") == g)
    model = of("hmm").select("scenario", "seed", "band", F.col("sharpe").alias("hmm"), "annual_turnover")
    both = model.join(of("vol").select("scenario", "seed", "band", F.col("sharpe").alias("vol")), ["scenario", "seed", "band"]).join(of("unfiltered").select("scenario", "seed", F.col("sharpe").alias("unfiltered")), ["scenario", "seed"])
    beats = lambda g: (F.col("hmm") > F.col(g)).cast("double")
    got = both.groupBy("scenario", "band").agg(
        F.count("*").cast("double").alias("n"), F.avg("hmm").alias("mean_sharpe"), F.avg("annual_turnover").alias("mean_turnover"),
        *(x for g in ("unfiltered", "vol") for x in (F.sum(beats(g)).alias(f"wins_{g}"), F.avg(F.col("hmm") - F.col(g)).alias(f"mean_d_{g}"))),
    )
    for g in ("unfiltered", "vol"):
        low, high = E.wilson(F.col(f"wins_{g}"), F.col("n"))
        got = got.withColumn(f"low_{g}", low).withColumn(f"high_{g}", high)
    return got


def capacity_book(rows: DataFrame, cfg: dict, gate_names: tuple[str, ...] = ("unfiltered", "hmm")) -> tuple[DataFrame, DataFrame]:
    """(weights, returns) of the whole book as one panel, currencies after trend
    instruments; run_id is path and gate. Each sleeve has half the book."""
    rows = keyed(rows)
    gates, _ = all_gates(rows, cfg)
    positions, returns = books(rows, cfg)
    n_trend = rows.where("table = 'trend'").agg(F.max("asset_idx") + 1).first()[0]
    place = lambda df: df.withColumn("asset_idx", F.when(F.col("run_id") == "carry", F.col("asset_idx") + n_trend).otherwise(F.col("asset_idx")))
    gated = place(positions).join(gates.where(F.col("series_id").isin(*gate_names)), ["path", "t"])
    weights = gated.select(F.concat_ws("|", "path", "series_id").alias("run_id"), "t", "asset_idx", (0.5 * F.col("p") * F.col("gate")).alias("p"))
    runs = weights.select("run_id", F.split("run_id", r"\|")[0].alias("path")).distinct()
    wide = place(returns).drop("run_id").join(runs, "path")
    return weights, wide.select("run_id", "t", "asset_idx", "r")


def capacity_assumptions(returns: DataFrame, n_trend: int, start: int, y_scale: float = 1.0, adv_scale: float = 1.0) -> C.CostAssumptions:
    """Illustrative spreads and volumes; volatilities measured from ``start`` on. A row per instrument reaches the driver."""
    sd = returns.where(F.col("t") >= start).groupBy("asset_idx").agg(F.stddev_pop("r").alias("s")).orderBy("asset_idx").collect()
    kind = [TREND_COST if r["asset_idx"] < n_trend else FX_COST for r in sd]
    return C.CostAssumptions(tuple(k[0] for k in kind), tuple(adv_scale * k[1] for k in kind), tuple(r["s"] for r in sd), y_scale)
