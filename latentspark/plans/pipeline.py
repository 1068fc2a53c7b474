"""The whole study of one dataset: fits, decoding, walk-forward gate, scaled
book, four backtests, combination and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators import hmm
from latentspark.operators.backtest import bincount, compute_metrics, run_backtest, state_conditional_returns
from latentspark.operators.strategies import scaled_book
from latentspark.sources.dataset import Dataset


def gate_settings(cfg: dict) -> dict:
    return {
        "n_states": cfg["n_states"], "tol": cfg["em_tol"], "max_iter": cfg["em_max_iter"], "var_floor": cfg["var_floor"], "train_min": cfg["train_min_days"], "refit": cfg["refit_days"],
        "mode": cfg["gate_mode"], "threshold": cfg["gate_threshold"], "gate_band": cfg.get("gate_band", 0.0), "transition_floor": cfg.get("transition_floor", 0.0), "calm_guard": cfg.get("calm_guard", 0.0),
    }


def run_full_pipeline(ds: Dataset, refit_days: int | None = None, train_min_days: int | None = None) -> dict[str, DataFrame]:
    """Result tables by name; all lazy but for the validation of inputs.

    Runs of ``daily`` are momentum and carry, unfiltered and filtered, and the
    50/50 book of each; ``attribution`` splits all six by decoded state."""
    cfg = dict(ds.config) | {k: v for k, v in (("refit_days", refit_days), ("train_min_days", train_min_days)) if v is not None}
    series = ds.index.select("series_id", "t", "x").persist()
    fits = hmm.fit_hmm(series, (2, 3), cfg["em_tol"], cfg["em_max_iter"], cfg["var_floor"]).persist()
    full = fits.where(F.col("k") == 3)
    path = hmm.decode(series, full).persist()
    days, models = hmm.regime_gate_report(series, **gate_settings(cfg))
    positions, returns, scale = scaled_book(ds.trend, ds.spot, ds.diffs, cfg)
    positions = positions.persist()
    gate = days.select("t", "gate")
    filtered = positions.join(gate, "t").withColumn("p", F.col("p") * F.col("gate")).drop("gate")
    tag = lambda df, name: df.withColumn("run_id", F.concat_ws("_", "run_id", F.lit(name)))
    both = tag(positions, "unfiltered").unionByName(tag(filtered, "filtered"))
    rets = tag(returns, "unfiltered").unionByName(tag(returns, "filtered")).select("run_id", "t", "asset_idx", "r").persist()
    daily = run_backtest(both, rets, cfg["cost_bps"]).persist()
    book = daily.groupBy(F.concat(F.lit("combined_"), F.element_at(F.split("run_id", "_"), -1)).alias("run_id"), "t").agg((0.5 * F.sum("net")).alias("net"))
    nets = daily.select("run_id", "t", "net").unionByName(book)
    dates = ds.index.select("t", "date")
    return {
        "fits": fits, "path": path, "counts": bincount(path, 3), "smoothed": hmm.smoothed_probabilities(series, full), "stationary": hmm.stationary_distribution(full), "regimes": hmm.regime_table(full),
        "accuracy": hmm.viterbi_accuracy(path, ds.states, full), "gate": days, "models": models, "scale": scale, "positions": positions, "daily": daily, "metrics": compute_metrics(nets, dates),
        "turnover": daily.groupBy("run_id").agg(F.avg("turnover").alias("mean_turnover")), "attribution": state_conditional_returns(nets, path, 3),
    }
