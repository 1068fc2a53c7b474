"""Small panels as DataFrames and back."""

import math

import numpy as np
import pandas as pd


def panel(spark, values, name="r", run_id=None):
    v = np.asarray(values, dtype=float)
    rows = [((run_id,) if run_id else ()) + (t, a, float(v[t, a])) for t in range(v.shape[0]) for a in range(v.shape[1])]
    return spark.createDataFrame(rows, ("run_id string, " if run_id else "") + f"t int, asset_idx int, {name} double")


def series(spark, values, name="x", key="s"):
    return spark.createDataFrame([(key, t, None if v is None else float(v)) for t, v in enumerate(values)], f"series_id string, t int, {name} double")


def states(spark, values, key="s"):
    return spark.createDataFrame([(key, t, int(v)) for t, v in enumerate(values)], "series_id string, t int, state int")


def column(df, name, order="t"):
    return df.toPandas().sort_values(order)[name].tolist()


def matrix(df, name="p"):
    return df.toPandas().pivot(index="t", columns="asset_idx", values=name).to_numpy()


def same_rows(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    """Whether two tables hold the same rows in any order; doubles to six decimals."""

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, (float, np.floating)):  # long columns with nulls come as doubles from one side
            return str(int(x)) if float(x).is_integer() else repr(round(float(x), 6) + 0.0)
        return str(x)

    cols = sorted(a.columns)
    assert cols == sorted(b.columns), (cols, sorted(b.columns))
    rows = lambda d: sorted(tuple(cell(x) for x in r) for r in d[cols].astype(object).itertuples(index=False, name=None))
    return rows(a) == rows(b)
