"""A long series fitted in chunks equals the plain fit; the public names and headline rows."""

import numpy as np
import pytest

from latentspark import api
from latentspark.operators import hmm_kernel as k
from latentspark.operators import hmm_long
from latentspark.plans import golden
from latentspark.sources import dgp
from tests.helpers import series
from tests.test_golden import CONFIG


def test_chunked_counts_and_fit(spark):
    rng = np.random.default_rng(7)
    x = np.where(np.arange(900) // 90 % 2 == 0, rng.normal(-0.01, 0.01, 900), rng.normal(0.02, 0.03, 900))
    df = series(spark, x)
    p, r = hmm_long.fit_long(df, 2, max_iter=6, rows=130)
    q, s = k.fit(x, 2, max_iter=6)
    assert np.allclose(r.loglik_history, s.loglik_history, rtol=1e-9) and r.n_iter == s.n_iter
    assert np.allclose(p.means, q.means, atol=1e-9) and np.allclose(p.transmat, q.transmat, atol=1e-7) and np.allclose(p.variances, q.variances, rtol=1e-6)
    with pytest.raises(ValueError):
        hmm_long.fit_long(series(spark, [0.0, 0.1]), 2)


def test_estimator(spark):
    x = np.random.default_rng(8).normal(0, 0.01, 200)
    m = api.GaussianHMM(2).fit(series(spark, x))
    assert m.viterbi(series(spark, x)).count() == 200 and m.information_criteria().first()["n_params"] == 7
    assert m.stationary_distribution().toPandas()["share"].sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        api.GaussianHMM(2).score(series(spark, x))
    with pytest.raises(ValueError):
        api.GaussianHMM(1)


def test_headline_rows(spark):
    ds = dgp.dataset(spark, CONFIG)
    value = lambda df: {(r["name"], r["key"]): r["value"] for r in df.collect()}
    got = value(golden.carry_rerank_rows(spark))
    assert got["rerank", "mean_turnover"] == pytest.approx(0.15873015873015872) and got["rerank_day21_asset0", "p"] == -1.0
    assert value(golden.gate_band_rows(ds))["gate_band_0.3", "sharpe"] == pytest.approx(1.364106196889773, abs=1e-8)
    got = value(golden.calm_guard_rows(ds))
    assert got["calm_guard", "mean_gate"] == pytest.approx(0.657205252058874, abs=1e-6) and got["calm_guard", "first_trip_day"] == 1007
