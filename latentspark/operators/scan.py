"""Ordered scans over long series: an associative operator, not one task a series.

Rows are dealt by range of (key, t), so a task holds neighbours in time, and are
packed into chunks of a bounded number of rows, one row a chunk. A chunk is
summarised by an element of some monoid, a list of numbers. :func:`prefixes` combines
the elements: for every chunk that of all chunks before it in its series and that of
all chunks after it, level by level where a series has very many. With these a chunk is worked
off on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.sources.scratch import sized, written

#: Rows of a chunk at most; a chunk is a row of two arrays of this length.
ROWS = 20_000
#: Tasks that even a small table is dealt to.
LEAST_TASKS = 64
#: Chunks that one partition may hold; chunk ids of partition p start at p times this.
PER_TASK = 1_000_000
#: Partitions whose chunks one task combines.
FAN = 1_024

Element = list[float]
PACKED = "series_id string, chunk long, t array<long>, x array<double>"


def packed(series: DataFrame, rows: int = ROWS, least_tasks: int = LEAST_TASKS) -> DataFrame:
    """(series_id, chunk, t, x): a series table (series_id string, t long, x double) as chunks of at most ``rows`` rows, written.

    Chunks of a series ascend in ``t``; rows with equal ``t`` are ordered by ``x``.
    Rows without a series or ``t`` are left out; nulls in ``x`` become NaN. No rows give
    no chunks. A series that holds most rows has most chunks."""
    have = series.select(F.col("series_id").cast("string"), F.col("t").cast("long"), F.col("x").cast("double")).where("series_id is not null and t is not null")
    n = have.count()
    tasks = max(1, min(n, least_tasks), -(-n // rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() * PER_TASK, 0
        key, t, x = None, [], []

        def out() -> pa.RecordBatch:
            nonlocal made
            made += 1
            ts, xs = np.concatenate(t), np.concatenate(x)
            arrays = [pa.array([key]), pa.array([first + made - 1]), pa.array([ts], pa.list_(pa.int64())), pa.array([xs], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, ["series_id", "chunk", "t", "x"])

        for b in batches:
            names = b.column(0).dictionary_encode()
            codes, words = np.asarray(names.indices), names.dictionary.to_pylist()
            ts, xs = np.asarray(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if t and key != words[codes[lo]]:
                    yield out()
                    t, x = [], []
                key = words[codes[lo]]
                while lo < hi:
                    take = min(hi - lo, rows - sum(map(len, t)))
                    t.append(ts[lo : lo + take])
                    x.append(xs[lo : lo + take])
                    lo += take
                    if sum(map(len, t)) == rows:
                        yield out()
                        t, x = [], []
        if t:
            yield out()

    dealt = have.repartitionByRange(tasks, "series_id", "t").sortWithinPartitions("series_id", "t", "x")
    return written(dealt.mapInArrow(pack, PACKED), "chunks")


def prefixes(chunks: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int = PER_TASK * FAN) -> DataFrame:
    """(series_id, chunk, before, after): the combined elements of all chunks before and after each one of its series, null where there are none.

    ``chunks`` has (series_id, chunk, m array<double>) with a row a chunk and should be a
    written table. ``combine`` is associative. A task combines at most ``width`` chunk numbers; the totals of such groups are combined
    in the same way one level up."""
    span = chunks.agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).first()
    groups = chunks.withColumn("g", F.floor(F.col("chunk") / width))

    def fold(ms: list[Element], start: Element | None) -> list[Element | None]:
        """Combined before each of ``ms``, and at last of all."""
        out = [None if start is None else np.asarray(start, dtype=float)]
        for m in ms:
            m = np.asarray(m, dtype=float)
            out.append(m if out[-1] is None else combine(out[-1], m))
        return out

    def fold_back(ms: list[Element], end: Element | None) -> list[Element | None]:
        out = [None if end is None else np.asarray(end, dtype=float)]
        for m in reversed(ms):
            m = np.asarray(m, dtype=float)
            out.append(m if out[-1] is None else combine(m, out[-1]))
        return out[::-1]

    if span["a"] is None or span["a"] // width == span["b"] // width:
        outer = groups.select("series_id", "g", "chunk", "m", F.lit(None).cast("array<double>").alias("up"), F.lit(None).cast("array<double>").alias("down"))
    else:

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "chunk": pdf["g"].iloc[:1], "m": [fold(pdf["m"].tolist(), None)[-1].tolist()]})

        totals = written(groups.groupBy("series_id", "g").applyInPandas(total, "series_id string, chunk long, m array<double>"), "totals")
        above = sized(written(prefixes(totals, combine, FAN).select("series_id", F.col("chunk").alias("g"), F.col("before").alias("up"), F.col("after").alias("down")), "prefixes"))
        outer = groups.join(above, ["series_id", "g"]).select("series_id", "g", "chunk", "m", "up", "down")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        ms, plain = pdf["m"].tolist(), lambda v: None if v is None else v.tolist()
        before, after = fold(ms, pdf["up"].iloc[0])[:-1], fold_back(ms, pdf["down"].iloc[0])[1:]
        return pd.DataFrame({"series_id": pdf["series_id"], "chunk": pdf["chunk"], "before": list(map(plain, before)), "after": list(map(plain, after))})

    return outer.groupBy("series_id", "g").applyInPandas(inside, "series_id string, chunk long, before array<double>, after array<double>")


def summarised(chunks: DataFrame, element: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(series_id, chunk, m): the element of each packed chunk, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"series_id": pdf["series_id"], "chunk": pdf["chunk"], "m": [element(np.asarray(x, dtype=float)).ravel().tolist() for x in pdf["x"]]})

    return written(chunks.select("series_id", "chunk", "x").mapInPandas(run, "series_id string, chunk long, m array<double>"), "elements")


def with_prefixes(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Packed chunks with their ``before`` and ``after``."""
    return chunks.join(sized(written(found, "prefixes")), ["series_id", "chunk"], "left")
