"""Results under one name: tables that belong together, and what is asked of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions import checks
from latentspark.operators.backtest import compute_metrics, flows, run_backtest
from latentspark.operators.evaluation import paired_block_bootstrap

SLEEVES = ("momentum", "carry")


@dataclass(frozen=True)
class BacktestResult:
    """``daily`` (run_id, t, gross, turnover, net, equity) and ``metrics``, a row per run."""

    daily: DataFrame
    metrics: DataFrame

    @classmethod
    def of(cls, positions: DataFrame, returns: DataFrame, cost_bps: float = 0.0, dates: DataFrame | None = None) -> BacktestResult:
        daily = run_backtest(positions, returns, cost_bps)
        return cls(daily, compute_metrics(daily, dates))

    def values(self, run_id: str) -> dict[str, float]:
        """One run's metrics by name."""
        row = self.metrics.where(F.col("run_id") == run_id).first()
        if row is None:
            raise ValueError(f"no run {run_id}")
        return {k: v for k, v in row.asDict().items() if k != "run_id"}


@dataclass(frozen=True)
class CombinedStream:
    """``daily`` (t, gross, turnover, momentum_turnover, carry_turnover) of the 50/50 book, cost-free."""

    daily: DataFrame

    def net(self, cost_bps: float) -> DataFrame:
        """(t, net): linear in the cost."""
        checks.scalar(cost_bps >= 0.0, f"cost_bps must be >= 0, got {cost_bps}")
        return self.daily.select("t", (F.col("gross") - cost_bps / 1e4 * F.col("turnover")).alias("net"))


@dataclass(frozen=True)
class GateBook:
    """Ungated ``positions`` (run_id, t, asset_idx, p) and ``returns`` of the sleeves momentum and carry, and the calendar ``dates`` (t, date)."""

    positions: DataFrame
    returns: DataFrame
    dates: DataFrame | None = None

    def stream(self, gate: DataFrame) -> CombinedStream:
        """The book under a gate (t, gate); days without a gate drop out."""
        held = self.positions.join(gate.select("t", "gate"), "t").select("run_id", "t", "asset_idx", (F.col("p") * F.col("gate")).alias("p"))
        each = flows(held, self.returns)
        own = lambda name: F.sum(F.when(F.col("run_id") == name, F.col("turnover"))).alias(f"{name}_turnover")
        return CombinedStream(each.groupBy("t").agg((0.5 * F.sum("gross")).alias("gross"), (0.5 * F.sum("turnover")).alias("turnover"), *map(own, SLEEVES)))


@dataclass(frozen=True)
class BootstrapResult:
    """A paired bootstrap of one pair of runs."""

    diff: float
    ci_low: float
    ci_high: float
    std_error: float
    prob_positive: float
    n_boot: int
    mean_block: float

    @classmethod
    def by_run(cls, pairs: DataFrame, n_boot: int = 10_000, mean_block: float = 21.0, level: float = 0.95, seed: int = 83) -> dict[str, BootstrapResult]:
        """One per run of (run_id, t, a, b)."""
        rows = paired_block_bootstrap(pairs, n_boot, mean_block, level, seed).collect()
        return {r["run_id"]: cls(r["diff"], r["low"], r["high"], r["std_error"], r["p_positive"], r["n_boot"], mean_block) for r in rows}
