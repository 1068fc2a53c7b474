"""Result classes, golden readers and writers, and the public names."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark import api
from latentspark.operators import evaluation as e
from latentspark.operators import hmm_kernel
from latentspark.operators.hmm import PARAMS, GaussianHMM
from latentspark.plans import golden
from latentspark.sources import dataset
from tests.helpers import column, panel, series


def _book(spark, n=40):
    rng = np.random.default_rng(4)
    one = lambda name, what, scale: panel(spark, rng.normal(size=(n, 2)) * scale, what, name)
    pos = one("momentum", "p", 1.0).unionByName(one("carry", "p", 1.0))
    ret = one("momentum", "r", 0.01).unionByName(one("carry", "r", 0.01))
    gate = series(spark, rng.uniform(size=n), "gate", "g")
    return pos, ret, gate


def test_gate_book_is_the_built_book(spark):
    pos, ret, gate = _book(spark)
    stream = api.GateBook(pos, ret).stream(gate)
    want = e.net(e.build_book(pos, ret, gate), 5.0)
    assert np.allclose(column(stream.net(5.0), "net"), column(want, "net"))
    both = stream.daily.toPandas()
    assert np.allclose(both["turnover"], 0.5 * (both["momentum_turnover"] + both["carry_turnover"]))
    with pytest.raises(ValueError):
        stream.net(-1.0)


def test_backtest_and_bootstrap_results(spark):
    pos, ret, _ = _book(spark)
    r = api.BacktestResult.of(pos, ret, 5.0)
    net = np.array(column(r.daily.where("run_id = 'carry'"), "net"))
    assert r.values("carry")["sharpe"] == pytest.approx(np.sqrt(252) * net.mean() / net.std())
    with pytest.raises(ValueError, match="no run"):
        r.values("other")
    pairs = r.daily.groupBy("t").agg(F.sum(F.when(F.col("run_id") == "carry", F.col("net"))).alias("a"), F.sum(F.when(F.col("run_id") != "carry", F.col("net"))).alias("b")).withColumn("run_id", F.lit("x"))
    got = api.BootstrapResult.by_run(pairs, 200, 5.0)["x"]
    assert got.ci_low <= got.ci_high and got.n_boot == 200 and 0 <= got.prob_positive <= 1 and got.mean_block == 5.0
    assert got.diff == pytest.approx(r.values("carry")["sharpe"] - r.values("momentum")["sharpe"])


def test_golden_values_and_readers(spark, tmp_path):
    found = api.carry_rerank_values(spark)
    assert set(found["rerank"]) == {"ann_return", "sharpe", "max_dd", "mean_turnover"} and found["rerank_day21_asset0"]["p"] == -found["rerank_day21_asset3"]["p"]
    cases = [{"name": n, "expect": v, "tol": 1e-9} for n, v in found.items()]
    (tmp_path / "golden.json").write_text(json.dumps({"cases": cases}, indent=1))
    rows = dataset.read_golden(spark, f"{tmp_path}/golden.json").collect()
    assert {(r["name"], r["key"]): r["expect"] for r in rows} == {(n, k): v for n, x in found.items() for k, v in x.items()} and {r["tol"] for r in rows} == {1e-9}
    dataset.write_json(golden.carry_rerank_rows(spark), f"{tmp_path}/rows")
    back = spark.read.json(f"{tmp_path}/rows").select("name", "key", "value").collect()
    assert golden.values(spark.createDataFrame(back)) == found


def test_set_params_is_validated(spark):
    good = ("s", 2, [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.0], [1.0]], [[1.0], [2.0]])
    table = lambda *rows: spark.createDataFrame(rows, f"series_id string, k int, {PARAMS}")
    x = np.random.default_rng(1).normal(size=30)
    m = GaussianHMM(2).set_params(table(good))
    got = np.stack(column(m.filtered_probabilities(series(spark, x)), "p"))
    assert np.allclose(got, hmm_kernel.filtered(api.HMMParams(*map(np.array, good[2:])), x[:, None]))
    bad = [(2, [0.5, 0.6]), (2, [1.5, -0.5]), (3, [[0.9, 0.1], [0.3, 0.8]]), (3, [[1.0], [1.0]]), (4, [[float("nan")], [1.0]]), (5, [[0.0], [2.0]]), (5, [[1.0]]), (3, None)]
    for at, value in bad:
        with pytest.raises(ValueError, match="series_id=bad"):
            GaussianHMM(2).set_params(table(good, ("bad", *good[1:at], value, *good[at + 1 :])))


def test_public_names_exist():
    assert {"BacktestResult", "BootstrapResult", "CombinedStream", "GateBook", "golden_cases", "as_of", "expanding_median"} <= set(api.__all__)
    assert all(getattr(api, n) is not None for n in api.__all__)
