"""Plain Lloyd clustering in integers.

Centroids are broadcast; tasks compute squared differences to each of them,
take the least (the lower number on ties) and add up their vectors per
centroid. Those sums, a row per task and centroid, meet in one ``groupBy``. All
arithmetic is in integers, so the result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import written
from latentspark.llm.integer_vectors import BLOCK, floor_mean, integer_rows

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row."""
    d = np.empty((len(x), len(centroids)), dtype=np.int64)
    for c, center in enumerate(centroids):
        diff = x - center
        d[:, c] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _blocks(pdf: pd.DataFrame, dims: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for at in range(0, len(pdf), BLOCK):
        part = pdf.iloc[at : at + BLOCK]
        yield part, np.frombuffer(b"".join(part["q"]), dtype="<i4").reshape(-1, dims).astype(np.int64)


def _round(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; the driver sees a row of sums per centroid."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    k, dims = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for pdf in batches:
            for _, x in _blocks(pdf, dims):
                best, _ = nearest(x, shared.value)
                count += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    total[c] += x[best == c].sum(axis=0)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "s": list(total[used])})

    found = kept.select("q").mapInPandas(sums, "cluster int, n long, s array<long>").groupBy("cluster")
    merged = found.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dims))).alias("s")).collect()
    after = centroids.copy()
    for r in merged:
        after[r["cluster"]] = floor_mean(r["s"], r["n"])
    shared.unpersist()
    return after


def cluster(
    df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector with ``dims`` components, none null or non-finite.

    Components become ``floor(scale * x)``. The start are the ``k`` vectors
    with the smallest sha256 of ``salt:vec_id``, in that order (all, if there are
    fewer); rows with one id are ordered by their components, null ids come last.
    After ``rounds`` rounds vectors are assigned once more; a centroid without
    vectors stays as it is.

    Null, short, long and non-finite vectors have no row. Repeated rows count
    and come out as often as they are there; null ids stay null; other columns
    are ignored, whatever their names. An empty table gives an empty result. Components over
    2,097,152 after scaling are an error. The driver holds ``k * dims`` numbers."""
    spark = df.sparkSession
    kept = integer_rows(df, scale, id_col, vector_col).where(F.col("n") == dims)
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.stack([np.frombuffer(r["q"], dtype="<i4").astype(np.int64) for r in first])
    for _ in range(rounds):
        centroids = _round(kept, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _blocks(pdf, dims):
                best, d = nearest(x, shared.value)
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "cluster": best.astype(np.int32), "distance": d})

    assigned = written(kept.select("vec_id", "q").mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, d, total, sha[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1") -> str:
    """DuckDB SQL for :func:`cluster` over ``embeddings``."""
    parts = [
        f"""v as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale}::double * x::double)::bigint) as q from embeddings
          where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"c0 as materialized (select (row_number() over (order by sha256('{salt}:' || vec_id)) - 1)::int as k, q from v order by sha256('{salt}:' || vec_id) limit {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} as materialized (select vec_id, any_value(q) as q, min({{'d': d, 'k': k}}) as b from (
              select vec_id, v.q, k, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{r} c) group by vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} as materialized (select c.k, coalesce(m.q, c.q) as q from c{r} c left join (
              select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from (
                select b.k as k, i, sum(x)::bigint as s, count(*) as n from (select b, unnest(q) as x, unnest(range(1, {dims} + 1)) as i from a{r}) group by 1, 2) group by k) m on m.k = c.k)"""
            )
    return f"""with {", ".join(parts)}
    select vec_id, b.k as cluster, b.d as distance, (sum(b.d) over (partition by b.k))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia,
      sha256(array_to_string(c.q, ',')) as centroid_sha256 from a{rounds} join c{rounds} c on c.k = b.k"""
