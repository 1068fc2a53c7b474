import numpy as np
import pytest

from latentspark.llm import embedding_dedup as ed


def _brute(rows, cosine):
    usable = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0 for _, v, lab in rows]
    root, count = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1:]
            if usable[i] and usable[j] and a == b and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                count[i] += 1
                count[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], count[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def _rows():
    rng = np.random.default_rng(0)
    base, out = rng.normal(size=(5, 6)), []
    for k in range(260):
        v = base[k % 5] + rng.normal(size=6) * rng.choice([0, 0.02, 0.1, 0.4])
        out.append([int(k * 7 % 1000), [float(x) for x in v], int(k % 2) if k % 40 else None])
    out[3][1], out[4][1], out[5][1], out[6][1] = None, [0.0] * 6, [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0]
    out[7][1], out[8][1], out[9][1] = [], [float("inf")] * 6, [1.0, 2.0]
    for k in range(20, 60, 2):  # a hot vector, and a scaled one
        out[k][1], out[k][2] = out[20][1], 0
    out[62][1], out[62][2] = [2 * x for x in out[20][1]], 0
    return [tuple(r) for r in out]


@pytest.mark.parametrize("cell", [25, 2048])
def test_links(spark, cell):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, key string, cell string")
    got = ed.link(df, cell=cell).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == _brute(rows, 0.98)


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = ed.CoverTree(x)
    for c, r, m, kids in zip(t.center, t.radius, t.members, t.children, strict=True):
        assert np.linalg.norm(x[m] - x[c], axis=1).max() <= r + 1e-6
        if len(kids):
            assert sorted(np.concatenate([t.members[k] for k in kids])) == sorted(m) and all(t.radius[k] <= 1.0 + 1e-9 for k in kids)


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ed.link(spark.createDataFrame([], schema)).count() == 0
    got = ed.link(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
