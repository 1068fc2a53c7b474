"""The study's headline numbers as rows (name, key, value), to be written as JSON and held against earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators import hmm
from latentspark.operators.backtest import bincount, compute_metrics, flows, run_backtest
from latentspark.operators.evaluation import build_book, net, sharpe
from latentspark.operators.gates import apply_gate_band
from latentspark.operators.strategies import carry_positions, carry_total_returns, scaled_book
from latentspark.plans.pipeline import gate_settings, run_full_pipeline
from latentspark.sources.dataset import Dataset, rerank_panel

#: The inputs of the re-rank, band and guard cases.
RERANK = {"n_days": 63, "switch_days": [0, 10, 42], "diffs": [[0.04, 0.03, 0.02, 0.01], [0.01, 0.02, 0.03, 0.04], [0.02, 0.02, 0.02, 0.02]]}
RERANK_RULE = {"top_n": 1, "bottom_n": 1, "rebalance_days": 21}
BAND = 0.3
GUARD = {"calm_guard": 0.01, "inject_t": 1000, "inject_return": -0.3}


def long_rows(df: DataFrame, name, columns: list[str]) -> DataFrame:
    """(name, key, value) from the named columns of ``df``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns))).alias("kv")
    return df.select(name.alias("name"), pairs).select("name", "kv.key", "kv.value")


def study_rows(ds: Dataset) -> DataFrame:
    """Likelihoods, counts, stationary shares, accuracy, metrics and turnover of the full study."""
    out = run_full_pipeline(ds)
    rows = long_rows(out["fits"], F.concat(F.lit("fit_k"), "k"), ["log_likelihood", "n_iter"])
    rows = rows.unionByName(long_rows(out["metrics"], F.col("run_id"), ["ann_return", "ann_vol", "sharpe", "max_dd", "calmar", "hit_rate", "worst_month"]))
    rows = rows.unionByName(long_rows(out["turnover"], F.col("run_id"), ["mean_turnover"])).unionByName(long_rows(out["accuracy"], F.lit("viterbi"), ["accuracy"]))
    rows = rows.unionByName(long_rows(bincount(out["path"], 3), F.concat(F.lit("days_in_state_"), "state"), ["n"]))
    return rows.unionByName(long_rows(out["stationary"], F.concat(F.lit("stationary_"), "state"), ["share"]))


def carry_rerank_panel(spark) -> DataFrame:
    """(t, asset_idx, diff) of the re-rank case."""
    return rerank_panel(spark, **RERANK)


def carry_rerank_rows(spark) -> DataFrame:
    """Positions and results of the carry rule on a panel whose ranking flips."""
    diffs = carry_rerank_panel(spark)
    p = carry_positions(diffs, **RERANK_RULE).withColumn("run_id", F.lit("rerank"))
    r = carry_total_returns(diffs.select("t", "asset_idx", F.lit(0.0).alias("r")), diffs)
    daily = run_backtest(p, r, 5.0)
    held = p.where("t in (15, 21, 42) and asset_idx in (0, 3)")
    rows = long_rows(held, F.concat(F.lit("rerank_day"), "t", F.lit("_asset"), "asset_idx"), ["p"])
    return rows.unionByName(long_rows(compute_metrics(daily), F.lit("rerank"), ["ann_return", "sharpe", "max_dd"])).unionByName(
        long_rows(flows(p, r).agg(F.avg("turnover").alias("mean_turnover")), F.lit("rerank"), ["mean_turnover"])
    )


def gate_band_rows(ds: Dataset, band: float = BAND) -> DataFrame:
    """Sharpe of the combined book under the banded gate."""
    gate = apply_gate_band(hmm.regime_gate(ds.index.select("series_id", "t", "x"), **gate_settings(ds.config)), band)
    pos, ret, _ = scaled_book(ds.trend, ds.spot, ds.diffs, ds.config)
    return long_rows(sharpe(net(build_book(pos, ret, gate), ds.config["cost_bps"])), F.lit(f"gate_band_{band}"), ["sharpe"])


def calm_guard_rows(ds: Dataset) -> DataFrame:
    """Mean gate, trips and first trip after a crash is put in by hand."""
    x = ds.index.select("series_id", "t", F.when(F.col("t") == GUARD["inject_t"], GUARD["inject_return"]).otherwise(F.col("x")).alias("x"))
    days, models = hmm.regime_gate_report(x, **(gate_settings(ds.config) | {"calm_guard": GUARD["calm_guard"]}))
    level = days.where(F.col("t") >= ds.config["train_min_days"] - 1).agg(F.avg("gate").alias("mean_gate"))
    trips = models.where("tripped").agg(F.count("*").alias("trip_count"), F.min("refit_t").alias("first_trip_day"))
    return long_rows(level, F.lit("calm_guard"), ["mean_gate"]).unionByName(long_rows(trips, F.lit("calm_guard"), ["trip_count", "first_trip_day"]))


def values(rows: DataFrame) -> dict[str, dict[str, float]]:
    """The rows of one of these tables as {name: {key: value}}; some dozens of numbers."""
    out: dict[str, dict[str, float]] = {}
    for r in rows.collect():
        out.setdefault(r["name"], {})[r["key"]] = r["value"]
    return out


def golden_cases(ds: Dataset) -> list[dict]:
    """A case per name with what it expects by key, as :func:`latentspark.sources.dataset.read_golden` reads them."""
    return [{"name": name, "expect": expect} for name, expect in sorted(values(study_rows(ds)).items())]


def carry_rerank_values(spark) -> dict[str, dict[str, float]]:
    return values(carry_rerank_rows(spark))


def gate_band_values(ds: Dataset, band: float = BAND) -> dict[str, float]:
    return next(iter(values(gate_band_rows(ds, band)).values()))


def calm_guard_values(ds: Dataset) -> dict[str, float]:
    return values(calm_guard_rows(ds))["calm_guard"]
