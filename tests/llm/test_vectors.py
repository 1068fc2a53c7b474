"""Vector codes and centroid clustering against plain loops over the whole table."""

import hashlib
import random

import numpy as np
import pytest

from latentspark.llm import centroid_clustering as cc
from latentspark.llm import integer_vectors as iv
from latentspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label string, q string, cluster string, `a b` string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def _whole(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def _rows(n=400, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(7, dims))
    out = [[int(i), [float(x) for x in np.round(base[rng.integers(7)] * 2 + rng.normal(size=dims) * 0.2, 2)], str(rng.integers(3)) if i % 11 else None] for i in rng.permutation(n)]
    for i in range(0, n // 3):  # a third of the rows is one vector
        out[i * 3][1] = out[0][1]
    bad = [None, [], [1.0] * (dims + 4), [None] * dims, [1.0] * (dims - 1) + [float("nan")], [float("inf")] + [0.0] * (dims - 1)]
    out += [[5000 + i, v, "0"] for i, v in enumerate(bad)]
    out += [list(out[1]), [None, out[2][1], "1"], [None, [float(i) for i in range(dims)], None]]
    return [tuple(r) for r in out]


def _lloyd(x, books, rounds):
    """Plain Lloyd by Python integers: codes and distances, then entries."""
    for r in range(rounds + 1):
        codes = [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books)) for v in x]
        if r == rounds:
            return codes, books
        for k in range(len(books)):
            mine = [v for v, (_, c) in zip(x, codes, strict=True) if c == k]
            if mine:
                books[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]


def _brute_cluster(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows if _whole(v) and len(v) == dims]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    order = sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], dtype="<i4").tobytes()))
    codes, books = _lloyd([q for _, q in kept], [list(q) for _, q in order[:k]], rounds)
    per = {}
    for d, c in codes:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in books]
    return sorted(((i is None, i or 0, c, d, per[c], sum(per.values()), sha[c]) for (i, _), (d, c) in zip(kept, codes, strict=True)))


@pytest.mark.parametrize("k", [5, 16, 1000])
def test_clusters_are_plain_lloyds(spark, k):
    rows = _rows(120 if k == 1000 else 400)
    got = cc.cluster(_table(spark, rows).repartition(5), k=k, rounds=3, dims=8, scale=64.0).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == _brute_cluster(rows, k, 3, 8, 64)


def _brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, v, lab in rows if _whole(v) and len(v) % parts == 0]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], dtype="<i4").tobytes()))
    kept = [r for r in kept if len(r[2]) == len(order[0][2])]
    order = [r for r in order if len(r[2]) == len(order[0][2])]
    w = len(order[0][2]) // parts
    cut = lambda q, p: q[p * w : (p + 1) * w]
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        found, b = _lloyd([cut(q, p) for _, _, q in kept], [list(cut(q, p)) for _, _, q in order[:entries]], rounds)
        books += [x for e in b for x in e]
        for j, (d, c) in enumerate(found):
            code[j] += f"{c:02x}"
            error[j] += d
    sums = {}
    for (_, lab, _), e in zip(kept, error, strict=True):
        sums[lab] = sums.get(lab, 0) + e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, c, e, sums[r[1]], sha) for r, c, e in zip(kept, code, error, strict=True))


@pytest.mark.parametrize(("entries", "groups"), [(256, 16), (20, 4), (7, 50), (3, 1)])
def test_codes_are_plain_lloyds(spark, entries, groups):
    rows = _rows(300, seed=entries)
    got = vc.compress(_table(spark, rows).repartition(3), parts=4, entries=entries, rounds=4, scale=16.0, groups=groups).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == _brute_codes(rows, 4, entries, 4, 16)


def test_integer_grid_with_many_ties(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)], None) for i in range(500)]
    got = vc.compress(_table(spark, rows), parts=2, entries=40, rounds=4, scale=2.0, groups=5).collect()
    assert sorted((False, *r) for r in got) == _brute_codes(rows, 2, 40, 4, 2)


def test_bounds_skip_most_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(64, 16)) * 400
    x = np.floor(centers[rng.integers(64, size=3000)] + rng.normal(size=(3000, 16)) * 15).astype(np.int64)
    books = vc.Books(x[None, :64].copy(), 16)
    codes = bounds = None
    looked = []
    for _ in range(5):
        codes, d, bounds, n = vc.assign_part(x, books.entries[0], books.group[0], books.drift[0], codes, bounds)
        looked.append(n)
        all_d = ((x[:, None] - books.entries[0][None]) ** 2).sum(axis=2)
        assert (codes == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
        others = np.where(np.arange(64)[None] == codes[:, None], np.inf, np.sqrt(all_d))
        assert all((bounds[:, g] <= others[:, books.group[0] == g].min(axis=1)).all() for g in range(16) if (books.group[0] == g).any())
        entries = books.entries.copy()
        for k in np.unique(codes):
            entries[0, k] = x[codes == k].sum(axis=0) // (codes == k).sum()
        books.move(entries)
    assert looked[0] == 3000 * 64 and looked[-1] < looked[0] / 10


def test_squares_are_exact_beyond_doubles():
    x, e = np.array([[1 << 21, 3]] * 2), np.array([[-(1 << 21), 1], [1 << 21, 4]])
    assert vc.squared(x, e).tolist() == [[(1 << 44) + 4, 1]] * 2
    far = np.array([[1 << 27, 1]])
    assert vc.squared(far, -far).tolist() == [[(1 << 56) + 4]]


def test_no_vectors_and_too_large_ones(spark):
    for rows in ([], [(1, None, None), (2, [None, 1.0], "a"), (3, [], "b")]):
        t = _table(spark, rows)
        assert vc.compress(t).count() == 0 and cc.cluster(t).count() == 0
    with pytest.raises(Exception, match="exact sums"):
        iv.integer_rows(_table(spark, [(1, [1e30] * 4, None)]), 64.0, "vec_id", "embedding")
