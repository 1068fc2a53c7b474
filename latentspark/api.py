"""The library's public names in one place."""

from latentspark.functions.windows import ewma_variance
from latentspark.operators.backtest import compute_metrics, max_drawdown, run_backtest, state_conditional_returns
from latentspark.operators.costs import CostAssumptions, aum_at_sharpe_fraction, capacity_moments, daily_cost_fraction, participation, sharpe_at, trade_cost
from latentspark.operators.evaluation import (
    BreakEven,
    annual_turnover,
    break_even_cost,
    build_book,
    classification_report,
    cost_sweep,
    gate_break_even,
    lag_sweep,
    paired_block_bootstrap,
    roc_auc,
    sharpe,
    stationary_bootstrap_indices,
    window_metrics,
)
from latentspark.operators.gates import apply_gate_band, constant_gate, crisis_episodes, ewma_ratio_gate, lag_gate, oracle_gate, vol_ratio_gate
from latentspark.operators.hmm import GaussianHMM, bic_table, regime_gate, regime_gate_report
from latentspark.operators.hmm_kernel import (
    DEAD_STATE_SUPPORT,
    MONOTONE_REL_TOL,
    EMStep,
    GateReport,
    HMMFitResult,
    HMMParams,
    RegimeFilter,
    apply_transition_floor,
    em_step_status,
    forward_step,
    select_calm_state,
    validate_params,
)
from latentspark.operators.hmm_long import fit_long
from latentspark.operators.band_scan import apply_band
from latentspark.operators.hmm_scan import best_path, posteriors
from latentspark.operators.median_scan import expanding_median
from latentspark.operators.ordered import as_of, numbered, running, trailing
from latentspark.operators.ranks import average_ranks, quantiles
from latentspark.operators.results import BacktestResult, BootstrapResult, CombinedStream, GateBook
from latentspark.operators.strategies import apply_gate, carry_positions, carry_total_returns, momentum_positions, portfolio_scale, scaled_book, winsorize_mad
from latentspark.plans.golden import BAND as GATE_BAND_INPUTS
from latentspark.plans.golden import GUARD as CALM_GUARD_INPUTS
from latentspark.plans.golden import RERANK as CARRY_RERANK_INPUTS
from latentspark.plans.golden import calm_guard_values, carry_rerank_panel, carry_rerank_values, gate_band_values, golden_cases
from latentspark.plans.pipeline import run_full_pipeline
from latentspark.sources.dataset import Dataset, load_config, load_dataset, read_dated_text, rerank_panel, write_dataset
from latentspark.plans.study import band_sweep, evaluate_paths, summarise, summarise_bands
from latentspark.streaming.ordered_filter import filter_in_order
from latentspark.streaming.regime_filter import filter_stream

__all__ = [name for name in dir() if not name.startswith("_")]
