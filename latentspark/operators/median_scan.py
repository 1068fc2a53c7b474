"""The median of all values so far, over series of any length.

Within a chunk of R rows the median moves by at most R places from where it was before
it, so a chunk needs of everything earlier only how many values lie below, and the few
around the middle. Counts by chunk and range of values, added up over earlier chunks,
say which ranges these are in; earlier chunks' values of just these ranges are sent to the chunk, which then
walks its rows with two heaps. No task holds a series, and a value that many rows share is sent with its count.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.scan import packed, prefixes
from latentspark.sources.scratch import sized, written

#: Ranges of values at most; chunks that ask for one range of which each is answered in a group of its own.
RANGES, ASKED = 1_024, 256


def _middle(before: np.ndarray, rows: int) -> tuple[int, int]:
    """First and last range that hold earlier values which may become the middle within ``rows`` more rows."""
    n = int(before.sum())
    upto = np.cumsum(before)
    low, high = max(n // 2 - rows - 2, 0), min(n // 2 + rows + 2, n - 1)
    return int(np.searchsorted(upto, low, "right")), int(np.searchsorted(upto, high, "right"))


def walk(x: np.ndarray, values: np.ndarray, counts: np.ndarray, below: int, n: int) -> list[float | None]:
    """The medians after each of ``x``, given ``n`` earlier values of which ``below`` are not told and lie below, ``values`` with
    ``counts`` are told, and the rest are not told and lie above. NaN in ``x`` is no value."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    upto = below + np.cumsum(counts)
    half = n // 2  # so many belong to the lower heap
    first, last = max(half - len(x) - 2, below), min(half + len(x) + 2, below + int(counts.sum()))
    told = values[np.searchsorted(upto, np.arange(first, last), "right")].tolist()
    low, high = [-v for v in told[: half - first]], told[half - first :]
    heapq.heapify(low)
    heapq.heapify(high)
    n_low, n_high, out = half, n - half, []
    for v in x.tolist():
        if v == v:
            if low and v < -low[0] or (not low and high and v < high[0] and n_low > n_high):
                heapq.heappush(low, -v)
                n_low += 1
            elif high and v > high[0]:
                heapq.heappush(high, v)
                n_high += 1
            else:
                heapq.heappush(low, -v)
                n_low += 1
            while n_low > n_high + 1:
                heapq.heappush(high, -heapq.heappop(low))
                n_low, n_high = n_low - 1, n_high + 1
            while n_high > n_low:
                heapq.heappush(low, -heapq.heappop(high))
                n_low, n_high = n_low + 1, n_high - 1
        total = n_low + n_high
        out.append(None if not total else -low[0] if total % 2 else 0.5 * (high[0] - low[0]))
    return out


def expanding_median(series: DataFrame, ranges: int = RANGES, asked: int = ASKED, **sizes: int) -> DataFrame:
    """(series_id, t, median): the median of all ``x`` of (series_id, t, x) up to each row; null while there is none.

    Nulls and NaN are no values. Exact wherever a series is cut: ``ranges`` come from approximate
    quantiles and decide only what is sent where. Rows without series or ``t`` have no result; no rows give no rows."""
    chunks = packed(series, **sizes)
    longest = chunks.groupBy("series_id").count().agg(F.max("count")).first()[0] or 1
    n = max(1, min(ranges, longest))
    cuts = [k / n for k in range(1, n)]
    values = chunks.select("series_id", F.explode("x").alias("x")).where(~F.isnan("x"))
    edges = F.percentile_approx("x", F.array(*map(F.lit, cuts)), F.lit(100 * n)) if cuts else F.array().cast("array<double>")
    held = chunks.join(sized(written(values.groupBy("series_id").agg(edges.alias("edges")), "edges")), "series_id", "left")

    def place(x: object, edges: object) -> tuple[np.ndarray, np.ndarray]:
        v = np.asarray(x, dtype=float)
        v = v[~np.isnan(v)]
        return v, np.searchsorted(np.asarray([] if edges is None else edges, dtype=float), v, "right")

    def histogram(batches):
        for pdf in batches:
            m = [np.bincount(place(x, e)[1], minlength=n).astype(float).tolist() for x, e in zip(pdf["x"], pdf["edges"], strict=True)]
            yield pd.DataFrame({"series_id": pdf["series_id"], "chunk": pdf["chunk"], "m": m})

    def cells(batches):
        for pdf in batches:
            for key, chunk, x, e in zip(pdf["series_id"], pdf["chunk"], pdf["x"], pdf["edges"], strict=True):
                v, at = place(x, e)
                if not len(v):
                    continue
                order = np.argsort(v, kind="stable")
                v, at = v[order], at[order]
                rows = [np.unique(part, return_counts=True) for part in np.split(v, np.flatnonzero(np.diff(at)) + 1)]
                yield pd.DataFrame({"series_id": key, "range": np.unique(at), "since": chunk, "v": [r[0] for r in rows], "n": [r[1] for r in rows]})

    def ask(batches):
        for pdf in batches:
            for key, chunk, m, before in pdf.itertuples(index=False, name=None):
                if before is not None and np.asarray(before).sum() > 0:
                    a, b = _middle(np.asarray(before), int(np.asarray(m).sum()))
                    yield pd.DataFrame({"series_id": key, "range": np.arange(a, b + 1), "chunk": chunk})

    counted = written(held.select("series_id", "chunk", "x", "edges").mapInPandas(histogram, "series_id string, chunk long, m array<double>"), "histograms")
    before = written(prefixes(counted, lambda a, b: a + b).drop("after"), "before")
    wanted = written(counted.join(before, ["series_id", "chunk"]).select("series_id", "chunk", "m", "before").mapInPandas(ask, "series_id string, range long, chunk long"), "wanted")
    groups = sized(written(wanted.groupBy("series_id", "range").agg(F.ceil(F.count("*") / asked).alias("groups")), "groups"))
    sent = held.select("series_id", "chunk", "x", "edges").mapInPandas(cells, "series_id string, range long, since long, v array<double>, n array<long>")
    sent = sent.join(groups, ["series_id", "range"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1))).drop("groups")
    dealt = wanted.join(groups, ["series_id", "range"]).withColumn("group", F.pmod(F.xxhash64("chunk"), F.col("groups")).cast("int")).drop("groups")
    told = dealt.join(sent, ["series_id", "range", "group"]).where(F.col("since") < F.col("chunk")).select("series_id", "chunk", "v", "n")

    def medians(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({"series_id": [], "t": [], "median": []})
        key, _, t, x, before = chunk.iloc[0]
        x = np.asarray(x, dtype=float)
        earlier, below = 0, 0
        if before is not None:
            counts = np.asarray(before)
            earlier = int(counts.sum())
            below = int(counts[: _middle(counts, int((~np.isnan(x)).sum()))[0]].sum()) if earlier else 0
        v = np.concatenate([np.empty(0), *told["v"]])
        c = np.concatenate([np.empty(0, dtype=np.int64), *told["n"]]).astype(np.int64)
        return pd.DataFrame({"series_id": key, "t": t, "median": pd.array(walk(x, v, c, below, earlier), dtype="Float64")})

    rows = chunks.join(before, ["series_id", "chunk"], "left").select("series_id", "chunk", "t", "x", "before")
    return rows.groupBy("series_id", "chunk").cogroup(told.groupBy("series_id", "chunk")).applyInPandas(medians, "series_id string, t long, median double")
