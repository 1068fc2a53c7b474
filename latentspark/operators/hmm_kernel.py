"""Hidden Markov recursions over one series, in NumPy.

Forward and backward passes work on chunks of days side by side: products of
the step matrices inside each chunk give the state at every chunk's start, and
then all chunks run their own days in lockstep. That takes about 3 * sqrt(T)
array operations instead of T.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

import numpy as np

#: A drop of the log-likelihood beyond this share of its size is not rounding.
MONOTONE_REL_TOL = 1e-6
#: A state whose expected days fall below this is dead.
DEAD_STATE_SUPPORT = 1e-12
#: Slack of probability sums.
STOCHASTIC_TOL = 1e-9


class EMStep(Enum):
    CONTINUE = "continue"
    CONVERGED = "converged"
    NON_MONOTONE = "non_monotone"


@dataclass
class HMMParams:
    """Start (K), transitions (K, K), means and variances (K, D)."""

    startprob: np.ndarray
    transmat: np.ndarray
    means: np.ndarray
    variances: np.ndarray


@dataclass
class HMMFitResult:
    log_likelihood: float
    n_iter: int
    converged: bool
    loglik_history: list[float] = field(default_factory=list)
    monotone: bool = True
    dead_state: int | None = None


def _need(ok: object, what: str) -> None:
    if not ok:
        raise ValueError(what)


def as_matrix(x: object) -> np.ndarray:
    """Observations as (T, D), D 1 or 2, finite and not empty."""
    x = np.asarray(x, dtype=float)
    x = x[:, None] if x.ndim == 1 else x
    _need(x.ndim == 2 and len(x) and x.shape[1] in (1, 2), "observations must be (T,) or (T, D) with D in {1, 2}")
    _need(np.isfinite(x).all(), "observations contain NaN or inf")
    return x


def validate_params(p: HMMParams, dim: int | None = None) -> HMMParams:
    pi, a, mu, var = (np.asarray(v, dtype=float) for v in (p.startprob, p.transmat, p.means, p.variances))
    k = pi.shape[0] if pi.ndim == 1 else 0
    _need(k >= 2 and a.shape == (k, k) and mu.ndim == 2 and mu.shape[0] == k and var.shape == mu.shape, "parameter shapes disagree")
    _need(dim is None or mu.shape[1] == dim, f"means must have {dim} columns")
    _need(all(np.isfinite(v).all() for v in (pi, a, mu, var)), "parameters contain NaN or inf")
    _need((var > 0).all(), "variances must be > 0")
    _need((pi >= 0).all() and abs(pi.sum() - 1) <= STOCHASTIC_TOL, "startprob must sum to 1")
    _need((a >= 0).all() and (np.abs(a.sum(axis=1) - 1) <= STOCHASTIC_TOL).all(), "rows of transmat must sum to 1")
    return HMMParams(pi, a, mu, var)


def emissions(p: HMMParams, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission densities over the largest of the day, and the log of that one."""
    d = x[:, None, :] - p.means[None]
    log_b = -0.5 * (math.log(2 * math.pi) + np.log(p.variances)[None] + d * d / p.variances[None]).sum(axis=2)
    top = log_b.max(axis=1)
    return np.exp(log_b - top[:, None]), top


def log_density(p: HMMParams, x: np.ndarray) -> np.ndarray:
    b, top = emissions(p, x)
    with np.errstate(divide="ignore"):
        return np.log(b) + top[:, None]


def _chunks(n: int) -> int:
    return max(1, math.isqrt(n))


def forward(b: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities and the daily normalisers; ValueError names the first day without likelihood."""
    n, k = b.shape
    first = pi * b[0]
    d0 = first.sum()
    _need(d0 > 0, "zero likelihood at t=0")
    alpha, norm = np.empty((n, k)), np.empty(n)
    alpha[0], norm[0] = first / d0, d0
    rest = n - 1
    if rest:
        width = _chunks(rest)
        m = -(-rest // width)
        padded = np.ones((m * width, k))
        padded[:rest] = b[1:]
        padded = padded.reshape(m, width, k)
        with np.errstate(invalid="ignore", divide="ignore"):
            prod = np.broadcast_to(np.eye(k), (m, k, k)).copy()
            for s in range(width):
                prod = (prod @ a) * padded[:, s, None, :]
                prod /= prod.sum(axis=(1, 2))[:, None, None]
            start = np.empty((m, k))
            cur = alpha[0]
            for c in range(m):
                start[c] = cur
                cur = cur @ prod[c]
                cur = cur / cur.sum()
            out, ds = np.empty((m, width, k)), np.empty((m, width))
            cur = start
            for s in range(width):
                cur = (cur @ a) * padded[:, s]
                d = cur.sum(axis=1)
                cur = cur / d[:, None]
                out[:, s], ds[:, s] = cur, d
        alpha[1:], norm[1:] = out.reshape(-1, k)[:rest], ds.ravel()[:rest]
    bad = np.flatnonzero(~(norm > 0))
    _need(not len(bad), f"zero likelihood at t={int(bad[0]) if len(bad) else -1}")
    return alpha, norm


def backward(b: np.ndarray, a: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Scaled backward variables, sharing the forward pass's normalisers."""
    n, k = b.shape
    beta = np.ones((n, k))
    rest = n - 1
    if rest:
        steps = (b[1:] / norm[1:, None])[::-1]  # from the last day back
        width = _chunks(rest)
        m = -(-rest // width)
        padded = np.ones((m * width, k))
        padded[:rest] = steps
        padded = padded.reshape(m, width, k)
        prod = np.broadcast_to(np.eye(k), (m, k, k)).copy()
        for s in range(width):
            prod = a[None] @ (padded[:, s, :, None] * prod)
        start, cur = np.empty((m, k)), np.ones(k)
        for c in range(m):
            start[c] = cur
            cur = prod[c] @ cur
        out, cur = np.empty((m, width, k)), start
        for s in range(width):
            cur = (padded[:, s] * cur) @ a.T
            out[:, s] = cur
        beta[:-1] = out.reshape(-1, k)[:rest][::-1]
    return beta


def score(p: HMMParams, x: np.ndarray) -> float:
    b, top = emissions(p, x)
    return float((np.log(forward(b, p.transmat, p.startprob)[1]) + top).sum())


def filtered(p: HMMParams, x: np.ndarray) -> np.ndarray:
    return forward(emissions(p, x)[0], p.transmat, p.startprob)[0]


def smoothed(p: HMMParams, x: np.ndarray) -> np.ndarray:
    b, _ = emissions(p, x)
    alpha, norm = forward(b, p.transmat, p.startprob)
    return alpha * backward(b, p.transmat, norm)


def viterbi(p: HMMParams, x: np.ndarray) -> np.ndarray:
    """Most likely path in log space; ties go to the lower state."""
    with np.errstate(divide="ignore"):
        log_a, delta = np.log(p.transmat), np.log(p.startprob)
    lb = log_density(p, x)
    delta = delta + lb[0]
    back = np.zeros(lb.shape, dtype=np.int64)
    cols = np.arange(lb.shape[1])
    for t in range(1, len(lb)):
        reach = delta[:, None] + log_a
        back[t] = reach.argmax(axis=0)
        delta = reach[back[t], cols] + lb[t]
    path = np.empty(len(lb), dtype=np.int64)
    path[-1] = delta.argmax()
    for t in range(len(lb) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def stationary(a: np.ndarray, tol: float = 1e-13, most: int = 10_000) -> np.ndarray:
    """Power method from the uniform distribution; ValueError if it doesn't settle."""
    pi = np.full(len(a), 1.0 / len(a))
    for _ in range(most):
        new = pi @ a
        new = new / new.sum()
        if np.abs(new - pi).max() < tol:
            return new
        pi = new
    raise ValueError("stationary distribution did not converge")


def pinned_init(x: np.ndarray, k: int, var_floor: float) -> HMMParams:
    """Means at the (2i+1)/2K quantiles, pooled variance, sticky transitions, uniform start."""
    q = [(2 * i + 1) / (2 * k) for i in range(k)]
    var = np.maximum(x.var(axis=0), var_floor)
    a = np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(a, 0.9)
    return HMMParams(np.full(k, 1.0 / k), a, np.quantile(x, q, axis=0), np.tile(var, (k, 1)))


def apply_transition_floor(p: HMMParams, floor: float) -> HMMParams:
    """Transitions with ``floor`` added, rows normalised; 0 changes nothing."""
    _need(math.isfinite(floor) and floor >= 0, "transition floor must be finite and >= 0")
    if floor == 0.0:
        return HMMParams(*(np.array(v, copy=True) for v in (p.startprob, p.transmat, p.means, p.variances)))
    a = p.transmat + floor
    return HMMParams(p.startprob.copy(), a / a.sum(axis=1, keepdims=True), p.means.copy(), p.variances.copy())


def em_step_status(ll: float, before: float, tol: float) -> EMStep:
    if not math.isfinite(ll) or ll - before < -MONOTONE_REL_TOL * max(1.0, abs(before)):
        return EMStep.NON_MONOTONE
    return EMStep.CONVERGED if ll - before < tol else EMStep.CONTINUE


def sort_states(p: HMMParams) -> HMMParams:
    """States in ascending order of their first mean; equal means keep their order."""
    o = np.argsort(p.means[:, 0], kind="stable")
    return HMMParams(p.startprob[o], p.transmat[np.ix_(o, o)], p.means[o], p.variances[o])


def n_params(k: int, dim: int) -> int:
    return 2 * k * dim + k * (k - 1) + (k - 1)


def fit(x: object, k: int, tol: float = 1e-8, max_iter: int = 500, var_floor: float = 1e-8, init: HMMParams | None = None, transition_floor: float = 0.0) -> tuple[HMMParams, HMMFitResult]:
    """Baum-Welch. Each round scores first, then classifies the step, then looks
    for dead states, then re-estimates; states are sorted once at the end."""
    _need(isinstance(k, (int, np.integer)) and not isinstance(k, bool) and k >= 2, "n_states must be an integer >= 2")
    _need(tol > 0 and var_floor > 0 and max_iter >= 1, "tol, var_floor and max_iter must be positive")
    x = as_matrix(x)
    _need(len(x) > k, f"needs more than {k} observations")
    p = pinned_init(x, k, var_floor) if init is None else apply_transition_floor(validate_params(init, x.shape[1]), transition_floor)
    result = HMMFitResult(float("nan"), 0, False)
    for _ in range(max_iter):
        b, top = emissions(p, x)
        alpha, norm = forward(b, p.transmat, p.startprob)
        ll = float((np.log(norm) + top).sum())
        result.loglik_history.append(ll)
        result.n_iter += 1
        if result.n_iter > 1:
            status = em_step_status(ll, result.loglik_history[-2], tol)
            result.monotone, result.converged = status != EMStep.NON_MONOTONE, status == EMStep.CONVERGED
            if status != EMStep.CONTINUE:
                break
        beta = backward(b, p.transmat, norm)
        gamma = alpha * beta
        support = gamma[:-1].sum(axis=0)
        dead = np.flatnonzero(support < DEAD_STATE_SUPPORT)
        if len(dead):
            result.dead_state = int(dead[0])
            break
        xi = p.transmat * (alpha[:-1].T @ (b[1:] * beta[1:] / norm[1:, None]))
        days = gamma.sum(axis=0)[:, None]
        means = gamma.T @ x / days
        spread = np.stack([(gamma[:, i, None] * (x - means[i]) ** 2).sum(axis=0) for i in range(k)])
        a = xi / support[:, None]
        p = HMMParams(gamma[0] / gamma[0].sum(), a / a.sum(axis=1, keepdims=True), means, np.maximum(spread / days, var_floor))
    else:
        result.loglik_history.append(score(p, x))
    result.log_likelihood = result.loglik_history[-1]
    return sort_states(p), result


def forward_step(p: HMMParams, before: object, x: object) -> np.ndarray:
    """Posterior after one observation, from the posterior before it."""
    p = validate_params(p)
    before = np.asarray(before, dtype=float)
    x = np.atleast_1d(np.asarray(x, dtype=float))
    _need(before.shape == p.startprob.shape and np.isfinite(before).all() and (before >= 0).all() and abs(before.sum() - 1) <= STOCHASTIC_TOL, "alpha_prev must be a distribution over the states")
    _need(x.shape == (p.means.shape[1],) and np.isfinite(x).all(), f"an observation has {p.means.shape[1]} finite values")
    alpha = (before @ p.transmat) * emissions(p, x[None])[0][0]
    _need(alpha.sum() > 0, "zero likelihood")
    return alpha / alpha.sum()


class RegimeFilter:
    """Online filter: parameters are checked once; a failed update leaves the state as it was."""

    def __init__(self, params: HMMParams, alpha_prev: object = None):
        self.params = validate_params(params)
        self._scale = math.log(2 * math.pi) + np.log(self.params.variances)
        self.reset(alpha_prev)

    def reset(self, alpha_prev: object = None) -> None:
        if alpha_prev is None:
            self.alpha, self.started = self.params.startprob.copy(), False
            return
        a = np.asarray(alpha_prev, dtype=float)
        _need(a.shape == self.params.startprob.shape and np.isfinite(a).all() and (a >= 0).all() and abs(a.sum() - 1) <= STOCHASTIC_TOL, "alpha_prev must be a distribution over the states")
        self.alpha, self.started = a.copy(), True

    def update(self, x: object) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, dtype=float))
        _need(x.shape == (self.params.means.shape[1],) and np.isfinite(x).all(), f"an observation has {self.params.means.shape[1]} finite values")
        prior = self.alpha @ self.params.transmat if self.started else self.alpha
        d = self.params.means - x[None]
        with np.errstate(over="ignore", invalid="ignore"):  # too far from all states is an error below
            log_b = -0.5 * (self._scale + d * d / self.params.variances).sum(axis=1)
            new = prior * np.exp(log_b - log_b.max())
        _need(new.sum() > 0, "zero likelihood")
        self.alpha, self.started = new / new.sum(), True
        return self.alpha.copy()


def select_calm_state(variance: np.ndarray, weight: np.ndarray, least: float) -> int:
    """The least variance among states of enough weight; else the largest weight. Ties go to the lower state."""
    variance, weight = np.asarray(variance, dtype=float), np.asarray(weight, dtype=float)
    enough = weight >= least
    return int(np.where(enough, variance, np.inf).argmin() if enough.any() else weight.argmax())


def winsorize(x: np.ndarray, width: float = 8.0) -> np.ndarray:
    mid = np.median(x)
    mad = np.median(np.abs(x - mid))
    return x.copy() if mad == 0 else np.clip(x, mid - width * 1.4826 * mad, mid + width * 1.4826 * mad)


def band(gate: np.ndarray, width: float) -> np.ndarray:
    """What is held follows the gate only when they differ by more than ``width``; 1 is held before the first day."""
    _need(0.0 <= width <= 1.0, f"band must be in [0, 1], got {width}")
    held, out = 1.0, np.empty(len(gate))
    for t, g in enumerate(gate):
        held = g if abs(g - held) > width else held
        out[t] = held
    return out


@dataclass
class GateReport:
    gate: np.ndarray
    p_calm: np.ndarray
    refit_t: np.ndarray
    models: list[tuple[int, HMMParams, HMMFitResult, int, bool]]

    @property
    def guard_trips(self) -> list[int]:
        return [t for t, _, _, _, tripped in self.models if tripped]


def walk_forward(
    r: object, n_states: int = 3, tol: float = 1e-8, max_iter: int = 500, var_floor: float = 1e-8, train_min: int = 504, refit: int = 63,
    mode: str = "prob", threshold: float = 0.5, gate_band: float = 0.0, transition_floor: float = 0.0, calm_guard: float = 0.0,
) -> GateReport:
    """Exposure gate of one series without lookahead.

    Refits on an expanding window every ``refit`` days from ``train_min - 1``,
    warm-started from the fit before; between refits one forward pass runs from
    the filtered state. The gate is the filtered probability of the state with
    the least variance, 1 before the first refit. With ``calm_guard``, a calm state of
    less stationary weight makes the day's refit use winsorised returns."""
    r = np.asarray(r, dtype=float)
    _need(r.ndim == 1 and len(r) and np.isfinite(r).all() and (r > -1).all(), "returns must be finite and > -1")
    _need(mode in ("prob", "binary"), f"unknown gate mode {mode!r}")
    _need(0.0 <= threshold <= 1.0, "threshold must be in [0, 1]")
    _need(0.0 <= gate_band <= 1.0, "band must be in [0, 1]")
    _need(0.0 <= calm_guard < 1.0, "calm_guard must be in [0, 1)")
    _need(train_min > n_states and refit >= 1 and len(r) >= train_min, "needs train_min > n_states, refit >= 1 and T >= train_min")
    _need(n_states >= 2 and tol > 0 and var_floor > 0 and max_iter >= 1 and math.isfinite(transition_floor) and transition_floor >= 0, "bad model settings")
    t0, x = train_min - 1, r[:, None]
    p_calm, refit_t = np.full(len(r), np.nan), np.full(len(r), -1)
    models: list[tuple[int, HMMParams, HMMFitResult, int, bool]] = []
    before: HMMParams | None = None
    for t in range(t0, len(r), refit):
        end = min(t + refit, len(r))
        try:
            window, tripped = x[: t + 1], False
            params, result = fit(window, n_states, tol, max_iter, var_floor, before, transition_floor)
            calm = int(params.variances[:, 0].argmin())
            if calm_guard > 0.0 and stationary(params.transmat)[calm] < calm_guard:
                tripped, window = True, winsorize(r[: t + 1])[:, None]
                params, result = fit(window, n_states, tol, max_iter, var_floor, before, transition_floor)
                calm = select_calm_state(params.variances[:, 0], stationary(params.transmat), calm_guard)
            alpha = filtered(params, window)[-1]
        except ValueError as e:
            raise ValueError(f"regime_gate refit at t={t}: {e}") from e
        p_calm[t], refit_t[t:end] = alpha[calm], t
        if end > t + 1:
            try:
                ahead = forward(emissions(params, x[t + 1 : end])[0], params.transmat, alpha @ params.transmat)[0]
            except ValueError as e:
                raise ValueError(f"regime_gate forward step after t={t}: {e}") from e
            p_calm[t + 1 : end] = ahead[:, calm]
        models.append((t, params, result, calm, tripped))
        before = params
    raw = np.where(refit_t >= 0, p_calm if mode == "prob" else (p_calm >= threshold).astype(float), 1.0)
    return GateReport(band(raw, gate_band), p_calm, refit_t, models)
