"""The filter in event-time order: late rows, a restart, a change of model and a start in the middle equal the batch."""

import datetime as dt
import random

import numpy as np
import pytest

from latentspark.operators import hmm_kernel as k
from latentspark.streaming import ordered_filter as of

P = k.HMMParams(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.array([[1.0], [2.0]]))
Q = k.HMMParams(np.array([0.5, 0.5]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[-2.0], [0.5]]), np.array([[1.5], [1.0]]))
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def _run(spark, tmp, rows, initial=None):
    spark.createDataFrame(rows, of.INPUT).coalesce(1).write.mode("append").parquet(str(tmp / "in"))
    stream = spark.readStream.schema(of.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    out = of.filter_in_order(stream, P, "30 seconds", initial).writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "state"))
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(of.OUTPUT).parquet(str(tmp / "out")).toPandas()


def _row(key, second, seq, x, op=None, model=None):
    return (key, T0 + dt.timedelta(seconds=second), seq, x, op, model)


def test_late_rows_restart_and_model_change_equal_batch(rocks, tmp_path):
    rng, r = np.random.default_rng(1), random.Random(1)
    x = {s: rng.normal(size=60).round(3) for s in ("a", "b")}
    rows = [_row(s, 10 * i, i, float(v)) for s in x for i, v in enumerate(x[s])]
    rows.append(_row("a", 255, 1000, None, "model", of.model_text(Q)))  # between observations 25 and 26
    rows.append(_row("b", 305, 1001, None, "reset"))
    rows.append(_row("b", 306, 1002, None))  # no value: an error, nothing else
    rows.sort(key=lambda row: row[1] + dt.timedelta(seconds=r.uniform(0, 25)))  # out of order by less than the delay
    initial = rocks.createDataFrame([("b", [0.9, 0.1], None)], "series_id string, alpha array<double>, model string")
    _run(rocks, tmp_path, rows[:70], initial)
    got = _run(rocks, tmp_path, rows[70:] + [_row("end", 5000, 1, 0.0)], initial)
    assert got.groupby("series_id").size().to_dict() == {"a": 61, "b": 62}

    f, want = k.RegimeFilter(P), []
    for i, v in enumerate(x["a"]):
        if i == 26:
            f = k.RegimeFilter(Q, f.alpha)
        want.append(f.update([v]))
    mine = got[(got.series_id == "a") & (got.seq < 1000)].sort_values("seq")
    np.testing.assert_allclose(np.stack(mine["alpha"]), want, atol=1e-12)
    f, want = k.RegimeFilter(P, [0.9, 0.1]), []
    for i, v in enumerate(x["b"]):
        if i == 31:
            f.reset()
        want.append(f.update([v]))
    mine = got[(got.series_id == "b") & (got.seq < 1000)].sort_values("seq")
    np.testing.assert_allclose(np.stack(mine["alpha"]), want, atol=1e-12)
    bad = got[got.error.notna()]
    assert bad["seq"].tolist() == [1002] and bad["alpha"].isna().all()
    # What the state store holds is what came out last.
    state = {row["key"][0]: row["value"] for row in rocks.read.format("statestore").option("stateVarName", "posterior").load(str(tmp_path / "state")).collect()}
    for s in ("a", "b"):
        last = got[(got.series_id == s) & got.error.isna()].sort_values("at")["alpha"].iloc[-1]
        assert list(state[s]["alpha"]) == list(last) and state[s]["started"]
    assert {state[s]["n"] for s in ("a", "b")} == {61, 62}


def test_rows_are_applied_in_order_and_bad_ones_change_nothing():
    rows = [(3, 1, 0.5, "x", None), (1, 1, -0.5, "x", None), (2, 9, None, "model", "[]"), (2, 8, None, "model", of.model_text(k.HMMParams(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.zeros((3, 1)), np.ones((3, 1)))))]
    out, model, alpha, started = of.apply_rows(P, None, False, rows)
    f = k.RegimeFilter(P)
    assert [o[:2] for o in out] == [(1, 1), (2, 8), (2, 9), (3, 1)] and [o[3] is None for o in out] == [True, False, False, True]
    assert out[0][2] == f.update([-0.5]).tolist() and alpha == out[3][2] == f.update([0.5]).tolist() and started and model.means.tolist() == P.means.tolist()


class _Store:
    """A series' state in memory that counts calls, each of which is a message to the JVM in a stream."""

    def __init__(self):
        self.calls, self.value, self.items = 0, None, []

    def getValueState(self, *a):
        return _Value(self)

    def getListState(self, *a):
        return _List(self)

    def registerTimer(self, ms):
        self.calls += 1


class _Value:
    def __init__(self, store):
        self.store = store

    def exists(self):
        self.store.calls += 1
        return self.store.value is not None

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls, self.store.value = self.store.calls + 1, value


class _List:
    def __init__(self, store):
        self.store = store

    def appendValue(self, item):
        self.store.calls += 1
        self.store.items.append(item)

    def get(self):
        self.store.calls += 1
        return iter(self.store.items)

    def put(self, items):
        self.store.calls, self.store.items = self.store.calls + 1, items

    def clear(self):
        self.put([])


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_series_costs_few_calls_of_the_state_store():
    x = np.random.default_rng(4).normal(size=25_000)
    rows = [("a", None, 1_000 * i, i, float(v), "x", None) for i, v in enumerate(x)]
    store, f = _Store(), of.OrderedFilter(P)
    f.init(store)
    assert list(f.handleInputRows(("a",), iter(rows[::-1]), _Now(0))) == [] and store.calls == 2 and len(store.items) == 1
    out = list(f.handleExpiredTimer(("a",), _Now(24_000), None))  # the last 1,000 rows stay
    assert store.calls == 7 and [len(r.seq) for r in out] == [10_000, 10_000, 4_000] and sum((r.seq for r in out), []) == list(range(24_000))
    out += list(f.handleExpiredTimer(("a",), _Now(25_000), None))
    assert store.calls == 11 and store.items == [] and store.value[1:] == (True, 25_000, None)
    np.testing.assert_allclose(np.concatenate([r.alpha for r in out]), k.filtered(P, x[:, None]), atol=1e-12)
