"""The online filter on Structured Streaming: parity with the batch filter, errors, restart."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from latentspark.operators import hmm_kernel as k
from latentspark.streaming.regime_filter import OUTPUT, filter_stream, step

P = k.HMMParams(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.array([[1.0], [2.0]]))
SCHEMA = "series_id string, seq long, x array<double>, op string"


def _run(spark, tmp, rows):
    part = tmp / "in"
    n = len(list(part.iterdir())) if part.exists() else 0
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(part))
    q = filter_stream(spark.readStream.schema(SCHEMA).parquet(str(part)), P).writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert n >= 0
    return spark.read.schema(OUTPUT).parquet(str(tmp / "out")).toPandas()


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=40)
    rows = [(s, i, [float(v)], None) for s in ("a", "b") for i, v in enumerate(x)]
    _run(spark, tmp_path, [r for r in rows if r[1] < 25])
    got = _run(spark, tmp_path, [r for r in rows if r[1] >= 25] + [("a", 3, [0.0], None), ("b", 40, [float("nan")], None), ("b", 41, [0.0, 1.0], None)])
    want = k.filtered(P, x[:, None])
    for s in ("a", "b"):
        mine = got[(got.series_id == s) & got.error.isna()].sort_values("seq")
        assert np.allclose(np.stack(mine["alpha"].to_list()), want, atol=1e-12)
    bad = got[got.error.notna()]
    assert len(bad) == 3 and bad["error"].str.contains("late").sum() == 1


def test_step_resets():
    out, alpha, started, last = step(P, None, False, -1, [(0, [0.5], "x"), (1, None, "reset"), (2, [0.5], "x"), (3, [0.3, 0.7], "reset"), (4, [1e200], "x")])
    assert np.allclose(out[0][1], out[2][1]) and out[4][2] and alpha == [0.3, 0.7] and started and last == 3


class _State:
    exists, value = False, None

    def update(self, value):
        self.value = value


@pytest.fixture
def update(spark, monkeypatch):
    """What the engine calls for a series and batch."""
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandasWithState", lambda self, f, *a: f)
    return filter_stream(spark.createDataFrame([], SCHEMA), P)


def test_a_long_series_waits_in_few_bytes_a_row(update):
    n, part = 120_000, 10_000
    seq, x = np.random.default_rng(2).permutation(n), np.random.default_rng(3).normal(size=n)
    pdfs = (pd.DataFrame({"seq": seq[k : k + part], "x": [np.array([v]) for v in x[seq[k : k + part]]], "op": "x"}) for k in range(0, n, part))
    state, alpha, rows = _State(), None, 0
    tracemalloc.start()
    for got in update(("a",), pdfs, state):
        assert got["seq"].tolist() == list(range(rows, rows + len(got))) and got["error"].isna().all()
        rows, alpha = rows + len(got), got["alpha"].iloc[-1]
        del got
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and state.value == (alpha, True, n - 1)
    np.testing.assert_allclose(alpha, k.filtered(P, x[:, None])[-1], atol=1e-12)
    assert most < 200 * n, most


def test_odd_rows_come_out_of_slices_as_of_one_piece(update):
    rows = [(s, [0.1 * (s % 7)], "x") for s in range(0, 30_000, 2)] + [(9_001, None, "reset"), (15_001, [0.3, 0.7], "reset"), (20_001, None, "x"), (20_003, [0.5, 0.5], "x"), (20_005, [], "x"), (20_007, [None], "x"), (20_002, [0.2], "x")]
    state = _State()
    got = pd.concat(update(("a",), iter([pd.DataFrame(rows[7_000:], columns=["seq", "x", "op"]), pd.DataFrame(rows[:7_000], columns=["seq", "x", "op"])]), state))
    out, alpha, started, last = step(P, None, False, -1, rows[7_000:] + rows[:7_000])
    assert got["seq"].tolist() == [o[0] for o in out] and got["error"].tolist() == [o[2] for o in out] and got["alpha"].tolist() == [o[1] for o in out]
    assert state.value == (alpha, started, last) and sum(o[2] is not None for o in out) == 5
