"""The hidden Markov recursions against enumeration and plain loops."""

import itertools
import math

import numpy as np
import pytest

from latentspark.operators import hmm
from latentspark.operators import hmm_kernel as k
from tests.helpers import column, series



def random_model(seed, n=2, dims=1):
    """Any transition rows, means and variances, none of them near zero."""
    rng = np.random.default_rng(seed)
    return k.HMMParams(rng.dirichlet(np.full(n, 4.0)), rng.dirichlet(np.full(n, 3.0), n), rng.normal(0, 1.5, (n, dims)), rng.uniform(0.3, 2.0, (n, dims)))


TINY = random_model(71)


def _enumerated(model, x):
    """Likelihood, best path and state shares from every path there is."""
    n, days = len(model.startprob), len(x)
    density = np.exp(k.log_density(model, x))
    weight = {}
    for path in itertools.product(range(n), repeat=days):
        steps = [model.startprob[path[0]], *(model.transmat[i, j] for i, j in itertools.pairwise(path))]
        weight[path] = math.prod(steps) * math.prod(density[t, i] for t, i in enumerate(path))
    total = math.fsum(weight.values())
    share = np.array([[math.fsum(w for p, w in weight.items() if p[t] == i) / total for i in range(n)] for t in range(days)])
    return total, max(weight, key=weight.get), share


@pytest.mark.parametrize(("n", "days", "dims"), [(2, 6, 1), (3, 5, 1), (4, 4, 2), (1, 3, 1), (2, 1, 3)])
def test_enumeration(n, days, dims):
    model, x = random_model(10 * n + days, n, dims), np.random.default_rng(days).normal(0, 2, (days, dims))
    total, path, share = _enumerated(model, x)
    assert k.score(model, x) == pytest.approx(math.log(total), abs=1e-11)
    assert np.allclose(k.smoothed(model, x), share, atol=1e-11)
    assert k.viterbi(model, x).tolist() == list(path)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400])
def test_chunks_agree_with_a_loop(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 1))
    b, _ = k.emissions(TINY, x)
    alpha, norm = k.forward(b, TINY.transmat, TINY.startprob)
    beta = k.backward(b, TINY.transmat, norm)
    a = TINY.startprob * b[0]
    for t in range(n):
        if t:
            a = (a @ TINY.transmat) * b[t]
        a = a / a.sum()
        assert np.allclose(alpha[t], a, atol=1e-12)
    v = np.ones(2)
    for t in range(n - 1, -1, -1):
        assert np.allclose(beta[t], v, rtol=1e-10)
        v = TINY.transmat @ (b[t] * v) / norm[t]


def test_fit_improves_and_sorts():
    rng = np.random.default_rng(1)
    x = np.where(np.arange(600) // 60 % 2 == 0, rng.normal(-0.01, 0.01, 600), rng.normal(0.02, 0.03, 600))
    p, r = k.fit(x, 2)
    assert r.converged and r.monotone and all(b >= a - 1e-9 for a, b in zip(r.loglik_history, r.loglik_history[1:], strict=False))
    assert p.means[0, 0] < p.means[1, 0] and np.allclose(p.transmat.sum(axis=1), 1)
    pi = k.stationary(p.transmat)
    assert np.allclose(pi @ p.transmat, pi, atol=1e-10)
    f = k.RegimeFilter(p)
    online = np.array([f.update(v) for v in x])
    assert np.allclose(online, k.filtered(p, x[:, None]), atol=1e-12)
    assert np.allclose(k.forward_step(p, online[10], x[11]), online[11], atol=1e-12)


def test_two_dimensions():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(4, 1, (150, 2))])
    p, _ = k.fit(x, 2)
    assert p.means.shape == (2, 2) and np.bincount(k.viterbi(p, x)).min() > 100


def test_pinned_start():
    x = np.random.default_rng(5).normal(size=(41, 1))
    p = k.pinned_init(x, 4, 1e-8)
    assert np.allclose(p.means.ravel(), np.quantile(x, [0.125, 0.375, 0.625, 0.875])) and np.allclose(p.variances, x.var())
    assert np.allclose(p.transmat, 0.1 / 3 + (0.9 - 0.1 / 3) * np.eye(4))


def test_dead_state():
    x = np.random.default_rng(6).uniform(-1, 1, 120)
    init = k.HMMParams(np.array([0.5, 0.5]), np.array([[0.6, 0.4], [0.4, 0.6]]), np.array([[0.0], [900.0]]), np.array([[0.4], [1e-6]]))
    p, r = k.fit(x, 2, init=init)
    assert r.dead_state == 1 and not r.converged and r.n_iter == 1 and np.isfinite(p.means).all()


def test_zero_likelihood_names_the_day():
    stuck = k.HMMParams(np.array([0.0, 1.0]), np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[-80.0], [0.0]]), np.array([[1e-7], [1e-7]]))
    with pytest.raises(ValueError, match="t=3"):
        k.filtered(stuck, np.array([[0.0], [0.0], [0.0], [-80.0]]))


def test_floor_revives_a_transition():
    level = np.repeat(np.tile([2.0, -2.0], 12), 8)
    x = level + np.random.default_rng(9).normal(0, 0.2, len(level))
    init = k.HMMParams(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.0, 1.0]]), np.array([[-2.0], [2.0]]), np.array([[0.1], [0.1]]))
    never, revived = (k.fit(x, 2, init=init, **more)[0].transmat[1, 0] for more in ({}, {"transition_floor": 2e-3}))
    assert never < 1e-12 and revived > 0.05


def test_viterbi_takes_impossible_steps_out():
    # The likeliest state of each day alone is 0, 1, 0, but no path leaves 1.
    p = k.HMMParams(np.array([0.7, 0.3]), np.array([[0.5, 0.5], [0.0, 1.0]]), np.array([[-1.5], [1.5]]), np.array([[1.0], [1.0]]))
    x = np.array([[-0.4], [2.5], [-0.3], [2.0]])
    path = k.viterbi(p, x).tolist()
    assert path == list(_enumerated(p, x)[1]) and path[1:] == [1, 1, 1]


def test_step_status_and_power_method():
    s = k.em_step_status
    assert s(1.0, 0.0, 1e-8) == k.EMStep.CONTINUE and s(0.0, 0.0, 1e-8) == k.EMStep.CONVERGED and s(-1.0, 0.0, 1e-8) == k.EMStep.NON_MONOTONE
    assert s(math.nan, 0.0, 1e-8) == k.EMStep.NON_MONOTONE and s(-1e-9, 0.0, 1e-8) == k.EMStep.CONVERGED
    to_and_fro = np.array([[0.0, 1.0, 0.0], [0.25, 0.0, 0.75], [0.0, 1.0, 0.0]])  # the middle state every other day
    with pytest.raises(ValueError):
        k.stationary(to_and_fro, most=201)
    assert np.allclose(k.stationary(np.full((3, 3), 1 / 3)), 1 / 3)


def test_bad_parameters():
    for bad in ({"n": 1}, {"n": 2, "tol": 0.0}, {"n": 2, "tol": math.nan}, {"n": True}):
        with pytest.raises(ValueError):
            k.fit(np.arange(10.0), bad.pop("n"), **bad)
    with pytest.raises(ValueError):
        k.fit([1.0, math.nan, 2.0], 2)
    with pytest.raises(ValueError):
        k.validate_params(k.HMMParams(np.array([0.5, 0.6]), TINY.transmat, TINY.means, TINY.variances))


def test_filter_keeps_its_state_on_errors():
    f = k.RegimeFilter(TINY)
    f.update(0.1)
    before = f.alpha.copy()
    for bad in (math.nan, [1.0, 2.0], math.inf):
        with pytest.raises(ValueError):
            f.update(bad)
        assert (f.alpha == before).all()


def test_calm_state_choice():
    """Against a plain loop, with ties in both variances and weights."""
    r = np.random.default_rng(12)
    for _ in range(300):
        n = int(r.integers(2, 6))
        var, w, least = r.integers(1, 4, n).astype(float), r.integers(1, 5, n).astype(float), float(r.choice([0.05, 0.2, 0.35, 0.6]))
        w /= w.sum()
        best = None
        for i in range(n):
            if w[i] >= least and (best is None or var[i] < var[best]):
                best = i
        if best is None:
            best = 0
            for i in range(n):
                if w[i] > w[best]:
                    best = i
        assert k.select_calm_state(var, w, least) == best


def test_gate_has_no_lookahead():
    r = np.random.default_rng(3).normal(0, 0.01, 260)
    r[120:150] *= 4
    kw = {"n_states": 2, "train_min": 60, "refit": 50, "max_iter": 60}
    full = k.walk_forward(r, **kw)
    changed = r.copy()
    changed[200:] = 0.05
    assert np.allclose(full.gate[:200], k.walk_forward(changed, **kw).gate[:200])
    assert (full.gate[:59] == 1).all() and [m[0] for m in full.models] == [59, 109, 159, 209, 259]
    binary = k.walk_forward(r, mode="binary", **kw)
    assert set(binary.gate) <= {0.0, 1.0}
    assert np.allclose(k.walk_forward(r, gate_band=0.3, **kw).gate, k.band(full.gate, 0.3))
    for bad in ({"threshold": 1.5}, {"mode": "x"}, {"train_min": 2}, {"calm_guard": 1.0}, {"refit": 0}):
        with pytest.raises(ValueError):
            k.walk_forward(r, **(kw | bad))


def test_grouped_models(spark):
    x = np.random.default_rng(4).normal(0, 0.01, 300)
    x[100:160] *= 5
    s = series(spark, x, key="a").unionByName(series(spark, x[::-1], key="b")).unionByName(series(spark, [0.0, 0.1], key="short"))
    fits = hmm.fit_hmm(s, (2,)).persist()
    rows = {r["series_id"]: r for r in fits.collect()}
    assert rows["short"]["error"] and rows["short"]["means"] is None
    p, r = k.fit(x, 2)
    assert rows["a"]["log_likelihood"] == pytest.approx(r.log_likelihood) and np.allclose(rows["a"]["means"], p.means)
    ok = fits.where("error is null")
    one = s.where("series_id = 'a'")
    assert column(hmm.decode(one, ok), "state") == k.viterbi(p, x[:, None]).tolist()
    assert np.allclose(np.stack(column(hmm.smoothed_probabilities(one, ok), "p")), k.smoothed(p, x[:, None]))
    assert hmm.log_likelihood(one, ok).first()["log_likelihood"] == pytest.approx(r.log_likelihood)
    table = hmm.bic_table(one, (1, 2)).toPandas().set_index("k")
    assert table.loc[2, "n_params"] == 7 and table.loc[2, "bic"] == pytest.approx(-2 * r.log_likelihood + 7 * math.log(300))
    days, models = hmm.regime_gate_report(one, n_states=2, train_min=100, refit=80)
    want = k.walk_forward(x, n_states=2, train_min=100, refit=80)
    assert np.allclose(column(days, "gate"), want.gate) and models.count() == len(want.models)
    hmm.register_udtf(spark)
    one.createOrReplaceTempView("one_series")
    short = spark.createDataFrame([("b", 0, 1.0), ("b", 1, 2.0)], "series_id string, t int, x double")
    one.unionByName(short.select(*one.columns)).createOrReplaceTempView("two_series")
    both = spark.sql("select * from fit_hmm(table(two_series) partition by (series_id) order by (t), k => 2)").toPandas()
    assert both["error"].notna().sum() == 1 and both.set_index("series_id").loc["b", "error"] and len(both) == 3
    got = spark.sql("select * from fit_hmm(table(one_series) partition by (series_id) order by (t), k => 2)").toPandas().sort_values("state")
    assert np.allclose(got["mean"], p.means.ravel())
