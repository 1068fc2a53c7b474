"""Every query with SQL gives DuckDB's rows; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry
from latentspark.plans import registry
from tests.helpers import same_rows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()
#: Costly ones without SQL that other tests cover by their parts.
SLOW = {"seed_sweep", "synthetic_paths", "bic_table", "gate_models", "calm_guard", "path_summary", "band_summary"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    assert len(got) == len(want) and same_rows(got, want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
