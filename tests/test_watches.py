"""Rules that ride along say what a scan of their own says, in the job that writes."""

import os

import numpy as np
import pytest

from latentspark.functions import checks
from latentspark.operators import backtest as b
from tests.helpers import panel


def _books(spark, p=None, r=None):
    rng = np.random.default_rng(0)
    pos, ret = rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) * 0.01
    for t, a, v in p or ():
        pos[t, a] = v
    for t, a, v in r or ():
        ret[t, a] = v
    return panel(spark, pos, "p", "run"), panel(spark, ret, "r", "run")


def test_same_rows_as_the_checked_backtest(spark, tmp_path):
    pos, ret = _books(spark)
    got = b.save_backtest(pos, ret, f"file://{tmp_path}/daily", 5.0).orderBy("t").collect()
    assert got == b.run_backtest(pos, ret, 5.0).select(*got[0].asDict()).orderBy("t").collect()
    assert os.listdir(tmp_path) == ["daily"] or sorted(os.listdir(tmp_path))[-1] == "daily"
    with pytest.raises(ValueError, match="exists"):
        b.save_backtest(pos, ret, f"file://{tmp_path}/daily", 5.0)


@pytest.mark.parametrize(("p", "r"), [([(7, 1, np.nan), (9, 0, np.inf)], None), (None, [(3, 0, -1.5), (2, 1, np.nan)]), ([(4, 0, 500.0)], [(5, 0, -0.5)])])
def test_same_messages_and_nothing_left(spark, tmp_path, p, r):
    pos, ret = _books(spark, p, r)
    with pytest.raises(ValueError) as plain:
        b.run_backtest(pos, ret, 5.0)
    with pytest.raises(ValueError) as riding:
        b.save_backtest(pos, ret, f"file://{tmp_path}/daily", 5.0)
    assert str(riding.value) == str(plain.value) and not [f for f in os.listdir(tmp_path) if not f.startswith(".")]


def test_no_job_of_its_own(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "t").repartition(4)
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        run()
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(name))

    def watched():
        w = checks.Watch(df, df["t"] < 0, ["t"], "t must not be negative")
        checks.write_watched(w.df, [w], f"file://{tmp_path}/a")

    assert jobs("watched", watched) == jobs("plain", lambda: df.write.parquet(f"file://{tmp_path}/b"))


def test_empty_tables_are_an_offence(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "t int").where("t > 5")
    w = checks.Watch(df, df["t"] < 0, ["t"], "t must not be negative")
    with pytest.raises(ValueError, match="no rows"):
        checks.write_watched(w.df, [w], f"file://{tmp_path}/a")
