"""The published results on the synthetic market of seed 19."""

import numpy as np
import pytest

from latentspark.operators import hmm_kernel as k
from latentspark.plans.pipeline import run_full_pipeline
from latentspark.sources import dgp

CONFIG = {
    "n_states": 3, "em_tol": 1e-8, "em_max_iter": 500, "var_floor": 1e-8, "momentum_lookback": 252, "vol_target": 0.1, "portfolio_vol_target": 0.1, "ewma_lambda": 0.94,
    "leverage_cap": 4.0, "carry_top_n": 3, "carry_bottom_n": 3, "rebalance_days": 21, "train_min_days": 504, "refit_days": 63, "gate_mode": "prob", "gate_threshold": 0.5,
    "cost_bps": 5.0, "trading_days": 252,
}
#: run: ann_return, ann_vol, sharpe, max_dd, hit_rate, worst_month (fixed values).
RUNS = {
    "momentum_unfiltered": (0.09231271526547008, 0.11043271355631928, 0.8359182011623011, -0.25215130760632964, 0.461, -0.0851547922984427),
    "momentum_filtered": (0.0606222515209965, 0.08755020072256799, 0.692428469845527, -0.21947265188669818, 0.4325, -0.07625322096416631),
    "carry_unfiltered": (0.061612153539385726, 0.17057841317143688, 0.3611954900615912, -0.6113334116092202, 0.5145, -0.16622292979645525),
}
SHARPE = {"carry_filtered": 0.9422122418440564, "combined_unfiltered": 0.780632, "combined_filtered": 1.211960}


@pytest.fixture(scope="module")
def path():
    s = dgp.simulate(19)
    return s | {"index": np.round(s["index"], 10)}


def test_states(path):
    assert np.bincount(path["states"]).tolist() == [1304, 470, 226]


def test_fits(path):
    p, r = k.fit(path["index"], 3)
    assert r.log_likelihood == pytest.approx(6643.076654247344, abs=1e-6) and r.n_iter == 71
    assert np.allclose(p.means.ravel(), [-0.00015786381843015143, 0.0005359935220997114, 0.0026544037568509526], atol=1e-5)
    assert np.bincount(k.viterbi(p, path["index"][:, None])).tolist() == [377, 1397, 226]
    assert np.allclose(k.stationary(p.transmat), [0.2455141869356436, 0.6204182628517696, 0.1340675502125867], atol=1e-8)
    assert np.allclose(k.smoothed(p, path["index"][:, None])[500], [0.15071370273698015, 0.8476063731537357, 0.00167992410927995], atol=1e-8)
    assert k.fit(path["index"], 2)[1].log_likelihood == pytest.approx(6612.453184053216, abs=1e-6)


def test_calm_guard(path):
    r = path["index"].copy()
    r[1000] = -0.3
    g = k.walk_forward(r, calm_guard=0.01)
    assert g.guard_trips[0] == 1007 and len(g.guard_trips) == 5
    assert g.gate[503:].mean() == pytest.approx(0.657205252058874, abs=1e-6)


def test_pipeline(spark):
    out = run_full_pipeline(dgp.dataset(spark, CONFIG))
    m = out["metrics"].toPandas().set_index("run_id")
    for run, want in RUNS.items():
        assert np.allclose(m.loc[run, ["ann_return", "ann_vol", "sharpe", "max_dd", "hit_rate", "worst_month"]].to_numpy(dtype=float), want, atol=1e-8), run
    for run, want in SHARPE.items():
        assert m.loc[run, "sharpe"] == pytest.approx(want, abs=1e-6)
    t = out["turnover"].toPandas().set_index("run_id")["mean_turnover"]
    assert (t["momentum_unfiltered"], t["carry_unfiltered"]) == (pytest.approx(0.111462, abs=1e-6), pytest.approx(0.136421, abs=1e-6))
    s = out["scale"].toPandas().sort_values("t")["scale"].to_numpy()
    assert (s[504], s[1500], s.max()) == (pytest.approx(2.79474077206761, abs=1e-8), pytest.approx(2.327265398250352, abs=1e-8), 4.0)
    assert out["accuracy"].first()["accuracy"] == pytest.approx(0.9045)
