"""Vector codes by Yinyang Lloyd.

A vector is cut into parts; a part's code is the number of the nearest entry of
that part's codebook. Codebooks are fitted by Lloyd rounds in which most distances
are never computed: entries are put into groups once, every part of every vector
keeps one lower bound per group, a round lowers it by the furthest that an entry
of the group has moved, and only groups whose bound is not above the distance
to the part's own entry are scanned. Bounds are floats rounded down and
only skip; whatever decides, ties too, is compared in integers. The bounds, a few
hundred bytes a vector, travel with the vectors from one written table to the
next, so a round is one pass without a shuffle of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from latentspark.llm.common import drop_written, sized_broadcast, written
from latentspark.llm.integer_vectors import BLOCK, floor_mean, integer_rows, packed, unpacked

#: Relative room that float bounds leave on the safe side.
ROOM = 1e-9


def entry_groups(book: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry of a codebook: a few Lloyd rounds from the entries that lie furthest apart."""
    x = book.astype(float)
    groups = min(groups, len(x))
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < groups:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centers = x[chosen]
    for _ in range(5):
        of = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.stack([x[of == g].mean(axis=0) if (of == g).any() else centers[g] for g in range(groups)])
    return of


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to integer entries, exactly: every term fits the 53 bits of a double, or 64-bit integers do the work."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    return ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)


def _below(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, rounded down."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign_part(x: np.ndarray, book: np.ndarray, groups: np.ndarray, drift: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part's codes, exact squared distances and bounds, and how many distances it took.

    ``codes`` and ``bounds`` are those of the round before (None in the first);
    ``drift`` holds how far each group's entries have moved since. A bound
    is at most the distance to any entry of the group but the part's own."""
    k, n_groups = len(book), len(drift)
    if codes is None:
        own, best = None, np.full(len(x), np.iinfo(np.int64).max)
        low, need = np.zeros((len(x), n_groups)), np.ones((len(x), n_groups), dtype=bool)
    else:
        diff = x - book[codes]
        own = np.einsum("ij,ij->i", diff, diff)
        best = own * k + codes
        low = bounds.astype(float) - drift[None]
        need = low <= (np.sqrt(own) * (1.0 + ROOM))[:, None]
    looked = 0
    first, second = {}, {}
    for g in range(n_groups):
        members = np.flatnonzero(groups == g)
        at = np.flatnonzero(need[:, g])
        if not len(members) or not len(at):
            continue
        key = squared(x[at], book[members]) * k + members
        looked += key.size
        if len(members) > 1:
            two = np.partition(key, 1, axis=1)[:, :2]
            first[g], second[g] = (at, two[:, 0]), two[:, 1]
        else:
            first[g], second[g] = (at, key[:, 0]), np.full(len(at), -1)
        best[at] = np.minimum(best[at], first[g][1])
    won, distance = best % k, best // k
    for g, (at, lead) in first.items():
        mine = lead == best[at]
        other = np.where(second[g] < 0, np.inf, np.sqrt(np.maximum(second[g], 0) // k))
        low[at, g] = np.where(mine, other, np.sqrt(lead // k)) * (1.0 - ROOM)
    if codes is not None:
        left = np.flatnonzero(won != codes)
        g = groups[codes[left]]
        low[left, g] = np.minimum(low[left, g], np.sqrt(own[left]) * (1.0 - ROOM))
    return won, distance, _below(low), looked


class Books:
    """The codebooks of all parts, their groups, and how far groups moved in the last round."""

    def __init__(self, entries: np.ndarray, groups: int):
        self.entries = entries  # part, entry, component
        self.group = np.stack([entry_groups(b, groups) for b in entries])
        self.n_groups = min(groups, entries.shape[1])
        self.drift = np.zeros((len(entries), self.n_groups))

    def move(self, entries: np.ndarray) -> None:
        moved = np.sqrt(((entries - self.entries) ** 2).sum(axis=2)) * (1.0 + ROOM)
        self.drift = np.stack([[m[g == i].max(initial=0.0) for i in range(self.n_groups)] for m, g in zip(moved, self.group, strict=True)])
        self.entries = entries


def _pass(state: DataFrame, books: Books, schema: StructType, last: bool) -> DataFrame:
    """Assigns all parts. Every task's last row holds its sums instead of a vector; the last pass gives codes and errors instead."""
    parts, k, width = books.entries.shape
    again = "codes" in state.columns
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros((parts, k, 1 + width), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                n = rows.num_rows
                x = unpacked(rows.column("q"), "<i4", parts * width).astype(np.int64).reshape(n, parts, width)
                old = unpacked(rows.column("codes"), "<u2", parts).astype(np.int64) if again else None
                low = unpacked(rows.column("bounds"), "<f4", parts * b.n_groups).reshape(n, parts, b.n_groups) if again else None
                codes, error, bounds = np.empty((n, parts), dtype=np.int64), np.zeros(n, dtype=np.int64), np.empty((n, parts, b.n_groups), dtype="<f4")
                for p in range(parts):
                    codes[:, p], d, bounds[:, p], _ = assign_part(x[:, p], b.entries[p], b.group[p], b.drift[p], old[:, p] if again else None, low[:, p] if again else None)
                    error += d
                    if not last:
                        total[p, :, 0] += np.bincount(codes[:, p], minlength=k)
                        for j in range(width):  # doubles hold a block's sums exactly
                            total[p, :, 1 + j] += np.bincount(codes[:, p], weights=x[:, p, j], minlength=k).astype(np.int64)
                if last:
                    text = pa.array(["".join(f"{c:02x}" for c in r) for r in codes.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])
                else:
                    arrays = [rows.column("vec_id"), rows.column("label"), rows.column("q"), packed(codes.astype("<u2")), packed(bounds.reshape(n, -1)), pa.nulls(n, pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(arrays, names)
        if not last:
            cells = pa.array([total.reshape(parts * k, 1 + width).tolist()], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, label_type), *(pa.nulls(1, pa.binary()) for _ in range(3)), cells], names)

    label_type = to_arrow_type(schema["label"].dataType)
    names = schema.names
    taken = ["vec_id", "label", "q", *(["codes", "bounds"] if again else [])]
    return written(state.where("q is not null").select(*taken).mapInArrow(run, schema), "vector-codes")


def _updated(state: DataFrame, books: Books) -> np.ndarray:
    """Entries after a round: exact floors of the means; entries without parts stay. The driver sees a row of sums per entry."""
    parts, k, width = books.entries.shape
    rows = state.where("sums is not null").select(F.posexplode("sums").alias("at", "s")).where("s[0] > 0")
    merged = rows.groupBy("at").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(1 + width))).alias("s")).collect()
    entries = books.entries.copy()
    for r in merged:
        entries[r["at"] // k, r["at"] % k] = floor_mean(r["s"][1:], r["s"][0])
    return entries


def compress(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, groups: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector.

    Components become ``floor(scale * x)``; a vector is cut into ``parts`` equal
    consecutive parts. A part position's codebook starts as that part of the
    ``entries`` smallest ids (all, if there are fewer; rows with one id are ordered by their
    components, null ids come last). Each of ``rounds`` rounds assigns every part to its nearest
    entry, the lower number on ties, and replaces each used entry by the floors
    of its parts' means; then parts are assigned again.

    Vectors that are null or empty or hold null or non-finite components have
    no row, nor have those with another length than the least id's vector, or
    with a length that ``parts`` doesn't divide. Repeated rows count and come out as often as they are there; null labels are
    one group; other columns are ignored, whatever their names. An empty table gives an empty result.
    Components over 2,097,152 after scaling are an error. At most 256 entries, which two hex digits name."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0 or groups < 1:
        raise ValueError("needs 1 to 256 entries, at least one part and one group, and no negative rounds")
    spark = df.sparkSession
    table = integer_rows(df, scale, id_col, vector_col, label_col)
    usable = table.where(F.col("n") % parts == 0)
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("n").limit(1).collect()
    label_type = table.schema["label"].dataType
    schema = StructType().add("vec_id", LongType()).add("label", label_type)
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = usable.where(F.col("n") == first[0]["n"])
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    books = Books(np.stack([np.frombuffer(r["q"], dtype="<i4").astype(np.int64).reshape(parts, -1) for r in start], axis=1), groups)
    state, between = kept, StructType([*schema.fields]).add("q", BinaryType()).add("codes", BinaryType()).add("bounds", BinaryType()).add("sums", ArrayType(ArrayType(LongType())))
    for r in range(rounds):
        done = _pass(state, books, between, last=False)
        books.move(_updated(done, books))
        drop_written(table if r == 0 else state)
        state = done
    result = _pass(state, books, StructType([*schema.fields]).add("code", StringType()).add("error", LongType()), last=True)
    if rounds:
        drop_written(state)
    sha = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    by_label = sized_broadcast(written(result.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label"))
    return result.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """DuckDB SQL for :func:`compress` over ``embeddings``."""
    tables = [
        f"""v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale}::double * x::double)::bigint) as q from embeddings
          where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))""",
        f"pt as materialized (select vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] as x from v, (select unnest(range({parts})) as p))",
        f"c0 as materialized (select p, (row_number() over (partition by p order by vec_id) - 1)::int as k, x as c from pt where vec_id in (select vec_id from v order by vec_id limit {entries}))",
    ]
    for r in range(rounds + 1):
        tables.append(
            f"""a{r} as materialized (select vec_id, p, any_value(x) as x, min({{'d': d, 'k': k}}) as b from (
              select vec_id, pt.p, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from pt join c{r} using (p)) group by vec_id, p)"""
        )
        if r < rounds:
            tables.append(
                f"""c{r + 1} as materialized (select o.p, o.k, coalesce(m.c, o.c) as c from c{r} o left join (
              select p, k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from (
                select p, b.k as k, i, sum(y)::bigint as s, count(*) as n from (select p, b, unnest(x) as y, unnest(range(1, len(x) + 1)) as i from a{r}) group by 1, 2, 3) group by p, k) m on m.p = o.p and m.k = o.k)"""
            )
    return f"""with {", ".join(tables)},
    e as (select vec_id, string_agg(lpad(lower(to_hex(b.k)), 2, '0'), '' order by p) as code, sum(b.d)::bigint as error from a{rounds} group by vec_id)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
      (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) from c{rounds}) as codebooks_sha256 from e join v using (vec_id)"""
