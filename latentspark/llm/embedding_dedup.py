"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label are dealt to cells around sampled centers. A cell keeps
the radius that covers its members, and two cells meet only if their bounds
let some pair be close enough. For each meeting, a task builds both cells'
cover trees (nested levels of halving radii) and walks them together: a pair
of nodes is left when its bound excludes every link, taken whole when it
guarantees every link, and opened otherwise. Pairs found are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import connected_components, sized_broadcast, written

#: Vectors of a cell at most; a larger one is split by hash.
CELL = 2048
#: Centers that are sampled at most; they travel with the tasks.
MAX_CENTERS = 4096
_LEAF = 16
#: More than the rounding of a distance between equal vectors.
_SLACK = 1e-6


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class CoverTree:
    """Nodes over unit vectors, breadth first. ``center`` is a point, ``radius``
    covers all points below, ``members`` are these points, ``children`` the
    node numbers of the next level (empty in a leaf)."""

    def __init__(self, points: np.ndarray, leaf: int = _LEAF):
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        waiting = [(self._node(np.arange(len(points))), 2.0)]
        while waiting:
            node, r = waiting.pop()
            mine = self.members[node]
            if len(mine) <= leaf or self.radius[node] == 0.0:
                continue
            while r / 2 >= self.radius[node]:
                r /= 2  # levels at which the node would be its own only child
            below = [self._node(x) for x in self._net(mine, r / 2)]
            self.children[node] = np.array(below)
            waiting += [(c, r / 2) for c in below]

    def _node(self, members: np.ndarray) -> int:
        self.center.append(int(members[0]))
        far = _distance(self.points[members[:1]], self.points[members])[0]
        far[0] = 0.0
        self.radius.append(float(far.max()))
        self.members.append(members)
        self.children.append(np.empty(0, dtype=np.int64))
        return len(self.center) - 1

    def _net(self, left: np.ndarray, r: float, block: int = 64) -> list[np.ndarray]:
        """Parts of ``left`` around centers that are further than ``r`` apart, each within ``r`` of its center."""
        parts = []
        while len(left):
            near = _distance(self.points[left[:block]], self.points[left]) <= r
            free = np.ones(len(left), dtype=bool)
            for k in range(len(near)):
                if free[k]:
                    near[k, k] = True
                    take = near[k] & free
                    free &= ~take
                    inside = np.flatnonzero(take)
                    parts.append(left[np.concatenate([[k], inside[inside != k]])])
            left = left[free]
        return parts


class Links:
    """Link counts and a spanning forest over the points of one meeting."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count = weight, np.zeros(len(weight), dtype=np.int64)
        self.root = list(range(len(weight)))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)

    def all_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of ``a`` with every point of ``b``, which share none."""
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        for x in (*a.tolist(), *b.tolist()):
            self.join(int(a[0]), x)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            self.join(x, y)


def traverse(a: CoverTree, b: CoverTree, links: Links, cosine: float, at_b: int) -> None:
    """Links between the points of ``a`` and those of ``b``, which ``links``
    numbers from ``at_b``. The same tree twice gives each unordered pair once."""
    same = a is b
    reach = float(np.sqrt(max(2.0 - 2.0 * cosine, 0.0)))
    ra, rb = np.array(a.radius), np.array(b.radius)
    ca, cb = np.array(a.center), np.array(b.center)
    waiting = [(0, 0)]
    while waiting:
        x, y = waiting.pop()
        kids_x, kids_y = a.children[x], b.children[y]
        if not len(kids_x) and not len(kids_y):
            mx, my = a.members[x], b.members[y]
            i, j = np.nonzero(a.points[mx] @ b.points[my].T >= cosine)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            links.pairs(mx[i], my[j] + at_b)
            continue
        # Open both; a leaf stands for itself.
        xs = kids_x if len(kids_x) else np.array([x])
        ys = kids_y if len(kids_y) else np.array([y])
        d = _distance(a.points[ca[xs]], b.points[cb[ys]])
        bound = ra[xs][:, None] + rb[ys][None, :]
        i, j = np.nonzero(d <= bound + reach + _SLACK)
        if same and x == y:
            i, j = i[i <= j], j[i <= j]
        whole = (d[i, j] + bound[i, j] <= reach - _SLACK) & ~((xs[i] == ys[j]) if same else np.zeros(len(i), bool))
        for p, q, w in zip(xs[i].tolist(), ys[j].tolist(), whole.tolist(), strict=True):
            if w:
                links.all_pairs(a.members[p], b.members[q] + at_b)
            else:
                waiting.append((p, q))


def _meeting(cosine: float) -> Callable[[pa.Table], pa.Table]:
    def meet(table: pa.Table) -> pa.Table:
        """Rows (meeting, side, cls, n, vec) in; (cls, root, n_links) of every linked class out."""
        side = table.column("side").to_numpy()
        order = np.lexsort((table.column("cls").to_numpy(), side))
        cls, n, side = table.column("cls").to_numpy()[order], table.column("n").to_numpy()[order], side[order]
        vec = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order].astype(np.float64)
        vec /= np.linalg.norm(vec, axis=1)[:, None]
        links, m = Links(n), int((side == 0).sum())
        first = CoverTree(vec[:m])
        if m == len(vec):
            traverse(first, first, links, cosine, 0)
        else:
            traverse(first, CoverTree(vec[m:]), links, cosine, m)
        hit = np.flatnonzero(links.count)
        root = np.array([links.find(int(x)) for x in hit], dtype=np.int64)
        return pa.table({"cls": cls[hit], "root": cls[root] if len(hit) else cls[:0], "n_links": links.count[hit]})

    return meet


def _nearest(centers: dict[str, tuple[np.ndarray, np.ndarray]]) -> Callable:
    def assign(batches):
        """Rows (cls, n, grp, vec) get the number of the nearest center of their group (0 without one) and the distance to it."""
        for b in batches:
            groups = np.array(b.column(2).to_pylist(), dtype=object)
            cell, far = np.zeros(b.num_rows, dtype=np.int64), np.full(b.num_rows, 2.0)
            vecs = b.column(3)
            for g in set(groups.tolist()):
                if g in centers:
                    rows = np.flatnonzero(groups == g)
                    x = vecs.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1).astype(np.float64)
                    d = _distance(x / np.linalg.norm(x, axis=1)[:, None], centers[g][1])
                    best = d.argmin(axis=1)
                    cell[rows], far[rows] = centers[g][0][best], d[np.arange(len(rows)), best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return assign


def link(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell: int = CELL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their sizes equal,
    and their cosine in double precision is at least ``cosine``. Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing and are kept. Equal rows link with each other; a null vec_id is
    nobody's component_id unless no other is reachable. A cosine equal to
    ``cosine`` links. Vectors of any length are compared whole. Other columns are
    ignored, whatever their names; no rows give no rows."""
    e = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v * v)
    usable = F.coalesce(F.col("label").isNotNull() & finite & (norm > 0) & (norm < float("inf")), F.lit(False))
    # Exact copies share a key, and one class stands for them.
    key = F.when(usable, F.md5(F.concat_ws(",", F.col("label"), F.size(e), e.cast("array<string>"))))
    keyed_rows = rows.select("vec_id", "vec", key.alias("key"), F.concat_ws("/", F.size(e), "label").alias("grp"))
    classes = written(
        keyed_rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    total = classes.count()
    every = max(cell, -(-total // MAX_CENTERS))
    picked = classes.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("cls", "grp", "vec").orderBy("key").limit(2 * MAX_CENTERS).collect()
    centers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in picked}:
        x = np.array([r["vec"] for r in picked if r["grp"] == g])
        centers[g] = (np.array([r["cls"] + 1 for r in picked if r["grp"] == g]), x / np.linalg.norm(x, axis=1)[:, None])
    near = written(classes.select("cls", "n", "grp", "vec").mapInArrow(_nearest(centers), "cls long, n long, grp string, vec array<double>, cell long, far double"), "cells")
    sizes = written(near.groupBy("grp", "cell").agg(F.count("*").alias("size")), "sizes")
    dealt = near.join(sized_broadcast(sizes), ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / cell)).cast("int"))
    cells = written(dealt.groupBy("grp", "cell", "part").agg(F.max("far").alias("far")), "cell-radii")
    c = _center_rows(classes, centers)
    placed = written(cells.join(c, F.col("cell") == F.col("c_cls") + 1, "left").drop("c_cls"), "placed")
    a, b = (placed.select("grp", *(F.col(x).alias(f"{x}_{s}") for x in ("cell", "part", "far", "at"))) for s in "ab")
    apart = F.sqrt(F.aggregate(F.zip_with("at_a", "at_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    reach = float(np.sqrt(max(2.0 - 2.0 * cosine, 0.0)))
    bounded = F.coalesce(apart <= F.col("far_a") + F.col("far_b") + reach + _SLACK, F.lit(True))
    meetings = written(
        a.join(b, "grp").where((F.struct("cell_a", "part_a") <= F.struct("cell_b", "part_b")) & bounded)
        .select("grp", "cell_a", "part_a", "cell_b", "part_b", F.xxhash64("grp", "cell_a", "part_a", "cell_b", "part_b").alias("meeting")),
        "meetings",
    )
    alone = (F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))
    seats = meetings.select("grp", F.col("cell_a").alias("cell"), F.col("part_a").alias("part"), "meeting", F.lit(0).alias("side")).unionByName(
        meetings.where(~alone).select("grp", F.col("cell_b").alias("cell"), F.col("part_b").alias("part"), "meeting", F.lit(1).alias("side"))
    )
    seated = dealt.join(sized_broadcast(written(seats, "seats")), ["grp", "cell", "part"]).select("meeting", "side", "cls", "n", "vec")
    found = written(seated.groupBy("meeting").applyInArrow(_meeting(cosine), "cls long, root long, n_links long"), "links")
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    between = found.groupBy("cls").agg(F.sum("n_links").alias("between"))
    least = classes.select("cls", "key", "n", "least").join(between, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = written(least, "members")
    heads = least.groupBy("root").agg(F.min("least").alias("component"))
    known = least.join(heads, "root").select("key", (F.col("n") - 1 + F.coalesce("between", F.lit(0))).alias("n_links"), "component")
    return keyed_rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component").isNull() | (F.col("vec_id") == F.col("component")), F.lit(False)).alias("kept"),
    )


def _center_rows(classes: DataFrame, centers: dict) -> DataFrame:
    """(c_cls, at): the sampled centers as unit vectors, at most ``2 * MAX_CENTERS`` rows."""
    rows = [(int(k) - 1, x.tolist()) for ids, vecs in centers.values() for k, x in zip(ids, vecs, strict=True)]
    return F.broadcast(classes.sparkSession.createDataFrame(rows, "c_cls long, at array<double>"))


def oracle(cosine: float = 0.98) -> str:
    """DuckDB SQL of ``link`` over ``embeddings``: all pairs of a label, then reachability."""
    return f"""
      with recursive v as (
        select vec_id, label, embedding::double[] as e from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          and list_dot_product(embedding::double[], embedding::double[]) > 0),
      links as (
        select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
        where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {cosine}),
      reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
      comp as (select a as vec_id, min(b) as component_id from reach group by a),
      n as (select a as vec_id, count(*) as n_links from links group by a)
      select c.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept
      from comp c left join n using (vec_id)"""
