"""Ordered scans, positions, windows, ranks and as-of joins cut into tiny pieces, against plain loops."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.operators import hmm_kernel as k
from latentspark.operators import band_scan, hmm_scan, median_scan, ordered, ranks, scan

P = k.HMMParams(np.array([0.7, 0.2, 0.1]), np.array([[0.9, 0.1, 0.0], [0.2, 0.7, 0.1], [0.0, 0.3, 0.7]]), np.array([[0.0], [1.0], [3.0]]), np.array([[1.0], [0.5], [2.0]]))


def _series(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    values = {key: np.round(rng.normal(size=n) * 2 + 1, 2) for key, n in sizes.items()}
    rows = [(key, 10 * t + 3, float(x)) for key, v in values.items() for t, x in enumerate(v)]
    random.Random(seed).shuffle(rows)
    return values, spark.createDataFrame(rows, "series_id string, t long, x double").repartition(3)


def test_posteriors_are_the_kernels(spark):
    values, df = _series(spark, {"long": 500, "short": 3, "one": 1})
    got = hmm_scan.posteriors(df, P, rows=7, least_tasks=5).toPandas().sort_values(["series_id", "t"])
    for key, v in values.items():
        x, mine = v[:, None], got[got["series_id"] == key]
        assert mine["t"].tolist() == [10 * t + 3 for t in range(len(v))]
        np.testing.assert_allclose(np.stack(mine["filtered"]), k.filtered(P, x), atol=1e-12)
        np.testing.assert_allclose(np.stack(mine["smoothed"]), k.smoothed(P, x), atol=1e-12)
        assert mine["log_density"].sum() == pytest.approx(k.score(P, x), abs=1e-8)


def test_best_paths_are_the_kernels(spark):
    values, df = _series(spark, {"long": 400, "short": 2, "one": 1}, seed=1)
    got = hmm_scan.best_path(df, P, rows=6, least_tasks=4).toPandas().sort_values(["series_id", "t"])
    for key, v in values.items():
        assert got[got["series_id"] == key]["state"].tolist() == k.viterbi(P, v[:, None]).tolist()


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_ties_go_to_the_lower_state_wherever_a_series_is_cut(spark, rows):
    """Two states alike: every path ties, and the lowest is the first state throughout."""
    same = k.HMMParams(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.array([[0.0], [0.0]]), np.array([[1.0], [1.0]]))
    _, df = _series(spark, {"a": 40}, seed=2)
    assert {r["state"] for r in hmm_scan.best_path(df, same, rows=rows, least_tasks=3).collect()} == {0}


def test_levels_of_prefixes(spark):
    """String-like elements show order: a number's digits are appended."""
    glue = lambda a, b: np.array([a[0] * 10 ** b[1] + b[0], a[1] + b[1]])
    rows = [("s", c * 3, [float(c % 9 + 1), 1.0]) for c in range(12)] + [("r", 5, [7.0, 1.0])]
    df = spark.createDataFrame(rows, "series_id string, chunk long, m array<double>")
    digits = "".join(str(c % 9 + 1) for c in range(12))
    for width in (4, 10, 1000):
        got = {(r["series_id"], r["chunk"]): (r["before"], r["after"]) for r in scan.prefixes(df, glue, width).collect()}
        assert got[("r", 5)] == (None, None)
        for c in range(12):
            before, after = got[("s", c * 3)]
            assert (None if before is None else str(int(before[0]))) == (digits[:c] or None)
            assert (None if after is None else str(int(after[0]))) == (digits[c + 1 :] or None)


def test_chunks_hold_all_rows_once_in_order(spark):
    values, df = _series(spark, {"a": 103, "b": 1})
    df = df.union(spark.createDataFrame([(None, 1, 2.0), ("a", None, 2.0), ("c", 1, None), ("c", 1, 5.0)], df.schema))
    got = sorted(scan.packed(df, rows=10, least_tasks=4).collect(), key=lambda r: (r["series_id"], r["chunk"]))
    assert max(len(r["t"]) for r in got) <= 10
    flat = [(r["series_id"], t, x) for r in got for t, x in zip(r["t"], r["x"], strict=True)]
    assert [f[:2] for f in flat] == sorted(f[:2] for f in flat) and len(flat) == 106
    assert [x for s, _, x in flat if s == "a"] == values["a"].tolist() and [x for s, _, x in flat if s == "c"][1] == 5.0
    assert hmm_scan.posteriors(df.where("false"), P).count() == 0 and hmm_scan.best_path(df.where("false"), P).count() == 0


def _keyed(spark, n=300, seed=3):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "b", None]), r.randrange(10**6), None if r.random() < 0.1 else round(r.uniform(-1, 1), 3)) for _ in range(n)]
    rows = list({row[:2]: row for row in rows}.values())
    return rows, spark.createDataFrame(rows, "k string, o long, x double").repartition(5)


def test_positions_windows_and_running_totals(spark):
    rows, df = _keyed(spark)
    at = ordered.numbered(df, ["k"], ["o"], "t", rows=20)
    tr = ordered.trailing(at, ["k"], "t", 6, {"s": lambda w: F.sum("x").over(w.rowsBetween(-6, 0)), "n": lambda w: F.count("*").over(w.rowsBetween(-6, 0))}, rows=6)
    ru = ordered.running(tr, ["k"], "t", {"total": ("sum", F.col("x")), "grown": ("product", 1 + F.col("x")), "top": ("max", F.col("x")), "low": ("min", F.col("x")), "have": ("count", F.col("x"))}, rows=7)
    got = {(r["k"], r["o"]): r for r in ru.collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        mine = sorted((o, x) for kk, o, x in rows if kk == key)
        for t, (o, _) in enumerate(mine):
            r, seen = got[(key, o)], [x for _, x in mine[: t + 1] if x is not None]
            last = [x for _, x in mine[max(0, t - 6) : t + 1] if x is not None]
            assert r["t"] == t and r["n"] == min(t + 1, 7) and r["have"] == len(seen)
            assert (r["s"] is None) == (not last) and (not last or r["s"] == pytest.approx(sum(last), abs=1e-12))
            if seen:
                assert r["total"] == pytest.approx(sum(seen)) and r["grown"] == pytest.approx(math.prod(1 + x for x in seen)) and (r["top"], r["low"]) == (max(seen), min(seen))
            else:
                assert r["total"] is r["grown"] is r["top"] is None
    assert ordered.numbered(df.where("false"), ["k"], ["o"]).count() == 0


def _ranks(values):
    s = sorted(values)
    return {v: (bisect.bisect_left(s, v) + bisect.bisect_right(s, v) + 1) / 2 for v in s}


def test_ranks_quantiles_and_auc(spark):
    r = random.Random(9)
    rows = [(r.choice("abb"), 0.5 if r.random() < 0.4 else round(r.random(), 2), r.random() < 0.3) for _ in range(400)] + [("a", None, True), ("a", float("nan"), False), ("c", None, True)]
    df = spark.createDataFrame(rows, "k string, x double, y boolean").repartition(4)
    ok = [(k_, x, y) for k_, x, y in rows if x is not None and x == x]
    want = _ranks([x for _, x, _ in ok])
    assert {row["x"]: row["rank"] for row in ranks.average_ranks(df, "x", rows=10).collect()} == want
    for keys in ([], ["k"]):
        got = {(row["k"] if keys else None, round(row["q"], 3)): row["value"] for row in ranks.quantiles(df, "x", [0.0, 0.1, 0.5, 1.0], keys, rows=9).collect()}
        for key in ("a", "b") if keys else (None,):
            v = [x for k_, x, _ in ok if key in (None, k_)]
            assert [got[(key, q)] for q in (0.0, 0.1, 0.5, 1.0)] == pytest.approx(np.quantile(v, [0, 0.1, 0.5, 1]).tolist())
        assert len(got) == (8 if keys else 4)
    n1 = sum(y for _, _, y in ok)
    auc = (sum(want[x] for _, x, y in ok if y) - n1 * (n1 + 1) / 2) / (n1 * (len(ok) - n1))
    assert ranks.roc_auc(df, "y", "x", rows=11).first()["auc"] == pytest.approx(auc)
    assert math.isnan(ranks.roc_auc(df.where("y"), "y", "x").first()["auc"])


def test_winsorize_by_group(spark):
    r = random.Random(4)
    rows = [("a", i, round(r.gauss(0, 1), 3) * (50 if i % 17 == 0 else 1)) for i in range(101)] + [("flat", i, 1.0 if i else 99.0) for i in range(9)] + [(None, 1, 5.0), ("a", 500, None)]
    got = {(x["k"], x["i"]): x["x"] for x in ranks.winsorize_mad(spark.createDataFrame(rows, "k string, i int, x double"), "x", 3.0, ["k"], rows=13).collect()}
    v = np.array([x for k_, _, x in rows if k_ == "a" and x is not None])
    m = np.median(v)
    s = np.median(np.abs(v - m)) * 3 * 1.4826
    assert len(got) == len(rows) and got[("flat", 0)] == 99.0 and got[(None, 1)] == 5.0 and got[("a", 500)] is None
    assert all(got[("a", i)] == pytest.approx(min(max(x, m - s), m + s)) for k_, i, x in rows if k_ == "a" and x is not None)


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of(spark, inclusive):
    r = random.Random(6)
    left = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(60)]), i) for i in range(150)]
    right = [(r.choice(["a", "a", "c", None]), r.choice([None, *range(0, 60, 3)]), r.randrange(9)) for _ in range(80)]
    lf, rf = spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, seen int, v int")
    lf = lf.withColumn("since", F.col("at") - 20)

    def plain(key, at, bound):
        fit = [(s, v) for kk, s, v in right if kk is not None and kk == key and s is not None and at is not None and (s <= at if inclusive else s < at)]
        best = max(fit, default=(None, None))
        return best if best[0] is not None and (not bound or best[0] >= at - 20) else (None, None)

    for bound in (False, True):
        got = ordered.as_of(lf, rf, ["k"], "at", "seen", ["v"], lambda t: F.floor(t / 7), inclusive, F.col("since") if bound else None)
        assert {x["i"]: (x["seen"], x["v"]) for x in got.collect()} == {i: plain(key, at, bound) for key, at, i in left}
    assert ordered.as_of(lf, rf.where("false"), ["k"], "at", "seen", ["v"], lambda t: F.floor(t / 7)).where("v is null").count() == len(left)


def test_band_functions_compose():
    rng = np.random.default_rng(5)
    for _ in range(200):
        g = np.round(np.cumsum(rng.normal(size=30)) * rng.choice([0.02, 0.1, 0.5]) + rng.uniform(), 2)
        width = float(rng.choice([0.0, 0.05, 0.1, 0.3]))
        cuts = sorted({0, 30, *rng.integers(1, 30, 3).tolist()})
        parts = [band_scan.effect(g[a:b], width) for a, b in zip(cuts, cuts[1:], strict=False)]
        left, right = parts[0], parts[-1]
        for p in parts[1:]:
            left = band_scan.combined(left, p, width)
        for p in parts[-2::-1]:
            right = band_scan.combined(p, right, width)
        for held in [*np.round(rng.uniform(-1, 2, 20), 2).tolist(), float(g[3]) + width, float(g[7]) - width]:
            want = band_scan.walk(g, width, held)[-1]
            assert band_scan.after(left, width, held) == band_scan.after(right, width, held) == want


@pytest.mark.parametrize("width", [0.0, 0.3, 50.0])
def test_band_is_the_walk(spark, width):
    values, df = _series(spark, {"long": 300, "short": 2}, seed=7)
    got = band_scan.apply_band(df, width, rows=8, least_tasks=4).toPandas().sort_values(["series_id", "t"])
    for key, v in values.items():
        assert got[got["series_id"] == key]["x"].tolist() == band_scan.walk(v, width, 1.0)
        assert width > 1 or band_scan.walk(v, width, 1.0) == k.band(v, width).tolist()
    assert band_scan.apply_band(df.where("false"), width).count() == 0


@pytest.mark.parametrize(("rows", "ranges", "asked"), [(1, 5, 2), (7, 4, 3), (7, 100, 256), (1000, 8, 256)])
def test_expanding_median(spark, rows, ranges, asked):
    rng = np.random.default_rng(rows)
    values = {"normal": rng.normal(size=150).round(2), "up": np.arange(90.0), "down": -np.arange(80.0), "hot": np.where(rng.random(120) < 0.5, 1.0, rng.normal(size=120)), "one": np.array([3.0])}
    rows_of = [(key, t, float(x) if t % 13 else None) for key, v in values.items() for t, x in enumerate(v)] + [("none", 0, None), ("none", 1, float("nan"))]
    df = spark.createDataFrame(rows_of, "series_id string, t long, x double").repartition(3)
    got = {(r["series_id"], r["t"]): r["median"] for r in median_scan.expanding_median(df, ranges, asked, rows=rows, least_tasks=4).collect()}
    assert len(got) == len(rows_of) and got[("none", 1)] is None
    for key, v in values.items():
        for t in range(len(v)):
            seen = [x for s, x in enumerate(v[: t + 1]) if s % 13]
            assert got[(key, t)] == (pytest.approx(np.median(seen)) if seen else None), (key, t)
    assert median_scan.expanding_median(df.where("false")).count() == 0
