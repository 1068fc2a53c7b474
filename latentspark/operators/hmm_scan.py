"""Hidden Markov passes of a given model over series of any length, as ordered scans.

A chunk's element is the product of its step matrices, ``diag(b0) A diag(b1) A ...``:
two neighbours combine as ``M A N``, so what lies before a chunk gives its first prior
and what lies after it its last backward vector. Best paths use the same scan with
(max, +) on scores of fixed precision, whose sums are exact: ties are the same wherever a series is cut. A
chunk's back pointers map the state after it to the state before it; these maps compose, so
chunks are decoded side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators import hmm_kernel as kernel
from latentspark.operators.scan import packed, prefixes, summarised, with_prefixes
from latentspark.sources.scratch import written

#: Scores are whole multiples of this many nats.
UNIT = 1e-6
#: Stands for the score of what can't be.
NEVER = -(1 << 60)


def product_of(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """diag(b0) A diag(b1) A ... up to a scale, pair by pair."""
    m = a[None] * b[:, None, :]
    m[0] = np.diag(b[0])
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = m[: len(m) // 2 * 2 : 2] @ m[1::2]
        m = np.concatenate([m / m.max(axis=(1, 2), keepdims=True), odd])
    return m[0] / m[0].max()


def backward_from(b: np.ndarray, a: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Backward variables up to a scale per row, from the last row's."""
    beta = np.empty_like(b)
    beta[-1] = last / last.sum()
    for t in range(len(b) - 1, 0, -1):
        v = a @ (b[t] * beta[t])
        beta[t - 1] = v / v.sum()
    return beta


def posteriors(series: DataFrame, params: kernel.HMMParams, smooth: bool = True, **sizes: int) -> DataFrame:
    """(series_id, t, filtered, smoothed, log_density) of every row of (series_id, t, x) under one given model.

    The sum of ``log_density`` over a series is its log-likelihood; ``smoothed`` is null
    without ``smooth``. Long series are cut anywhere without changing the result but by rounding. Observations must be
    finite: a null or NaN is an error, as is an observation without likelihood. Series of one row and empty tables work; rows without
    series or ``t`` have no result."""
    p = kernel.validate_params(params, 1)
    k, a = len(p.startprob), np.asarray(p.transmat)
    chunks = packed(series, **sizes)

    def combine(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = m.reshape(k, k) @ a @ n.reshape(k, k)
        return (out / out.max()).ravel()

    elements = summarised(chunks, lambda x: product_of(kernel.emissions(p, kernel.as_matrix(x))[0], a))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, t, x, before, after in pdf.itertuples(index=False, name=None):
                b, top = kernel.emissions(p, kernel.as_matrix(np.asarray(x, dtype=float)))
                prior = p.startprob
                if before is not None:
                    v = p.startprob @ np.asarray(before).reshape(k, k)
                    prior = (v / v.sum()) @ a
                alpha, norm = kernel.forward(b, a, prior)
                gamma = [None] * len(t)
                if smooth:
                    beta = backward_from(b, a, np.ones(k) if after is None else a @ np.asarray(after).reshape(k, k).sum(axis=1))
                    g = alpha * beta
                    gamma = list(g / g.sum(axis=1, keepdims=True))
                yield pd.DataFrame({"series_id": key, "t": t, "filtered": list(alpha), "smoothed": gamma, "log_density": np.log(norm) + top})

    rows = with_prefixes(chunks, prefixes(elements, combine)).select("series_id", "t", "x", "before", "after")
    return rows.mapInPandas(run, "series_id string, t long, filtered array<double>, smoothed array<double>, log_density double")


def _whole(log_p: np.ndarray) -> np.ndarray:
    """Logarithms as whole multiples of the unit."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(log_p), np.round(np.where(np.isfinite(log_p), log_p, 0.0) / UNIT), NEVER).astype(np.int64)


def _scores(p: kernel.HMMParams, x: np.ndarray) -> np.ndarray:
    d = kernel.as_matrix(x) - p.means[:, 0][None]
    return _whole(-0.5 * (math.log(2 * math.pi) + np.log(p.variances[:, 0])[None] + d * d / p.variances[:, 0][None]))


def _best(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(max, +) products of two stacks of score matrices."""
    out = (m[..., :, :, None] + n[..., None, :, :]).max(axis=-2)
    return np.where(out < NEVER // 2, NEVER, out)


def _best_product(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    k = s.shape[1]
    m = np.maximum(a[None] + s[:, None, :], NEVER)
    m[0] = np.where(np.eye(k, dtype=bool), s[0][None], NEVER)
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([_best(m[: len(m) // 2 * 2 : 2], m[1::2]), odd])
    return m[0]


def _pack_scores(m: np.ndarray) -> np.ndarray:
    """Integers as pairs of doubles, which elements are made of: 2^26 times the first plus the second."""
    m = m.ravel()
    return np.concatenate([(m >> 26).astype(float), (m & ((1 << 26) - 1)).astype(float)])


def _unpack_scores(v: object, k: int) -> np.ndarray:
    v = np.asarray(v)
    half = len(v) // 2
    return ((v[:half].astype(np.int64) << 26) + v[half:].astype(np.int64)).reshape(-1, k)


def best_path(series: DataFrame, params: kernel.HMMParams, **sizes: int) -> DataFrame:
    """(series_id, t, state): the most likely states of every series of (series_id, t, x) under one given model.

    Scores are log-densities and log-probabilities rounded to a millionth of a nat and
    added as integers, so a path doesn't depend on where its series is cut; ties go to the lower state. Observations
    must be finite; rows without series or ``t`` have no result; no rows give no rows."""
    p = kernel.validate_params(params, 1)
    k = len(p.startprob)
    with np.errstate(divide="ignore"):
        a, pi = _whole(np.log(p.transmat)), _whole(np.log(p.startprob))
    chunks = packed(series, **sizes)
    combine = lambda m, n: _pack_scores(_best(_best(_unpack_scores(m, k), a), _unpack_scores(n, k)))
    elements = summarised(chunks, lambda x: _pack_scores(_best_product(_scores(p, x), a)))

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A chunk's back pointers, the map they make, and its best last state, should the series end here."""
        into = [[int(a[i, j]) for i in range(k)] for j in range(k)]
        for pdf in batches:
            for key, chunk, t, x, before in pdf.itertuples(index=False, name=None):
                s = _scores(p, np.asarray(x, dtype=float)).tolist()
                start = None if before is None else (pi[:, None] + _unpack_scores(before, k)).max(axis=0).tolist()
                pointers = np.zeros((len(t), k), dtype=np.uint8)
                came = list(range(k))
                best = start
                for i, row in enumerate(s):
                    if best is None:
                        best = [int(v) + row[j] for j, v in enumerate(pi)]
                        continue
                    now, back = [0] * k, [0] * k
                    for j in range(k):
                        top, at = None, 0
                        for h in range(k):
                            v = best[h] + into[j][h]
                            if top is None or v > top:
                                top, at = v, h
                        now[j], back[j] = max(top + row[j], NEVER), at
                    pointers[i] = back
                    came = [came[h] for h in back] if i else back
                    best = now
                last = max(range(k), key=lambda j: (best[j], -j))
                yield pd.DataFrame({"series_id": [key], "chunk": [chunk], "t": [t], "back": [pointers.tobytes()], "m": [[float(c) for c in came]], "last": [last]})

    rows = with_prefixes(chunks, prefixes(elements, combine)).select("series_id", "chunk", "t", "x", "before")
    walked = written(rows.mapInPandas(forward, "series_id string, chunk long, t array<long>, back binary, m array<double>, last int"), "pointers")
    ends = walked.groupBy("series_id").agg(F.max_by("last", "chunk").alias("last"))
    # A map takes the state at the end of a chunk to the state at the end of the chunk before.
    later = prefixes(walked.select("series_id", "chunk", "m"), lambda m, n: m[n.astype(int)])
    final = later.join(ends, "series_id").select("series_id", "chunk", F.when(F.col("after").isNull(), F.col("last")).otherwise(F.get("after", F.col("last")).cast("int")).alias("state"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, t, back, state in pdf.itertuples(index=False, name=None):
                pointers = np.frombuffer(back, dtype=np.uint8).reshape(-1, k).tolist()
                states = [0] * len(pointers)
                for i in range(len(pointers) - 1, -1, -1):
                    states[i] = state
                    state = pointers[i][state]
                yield pd.DataFrame({"series_id": key, "t": t, "state": states})

    packs = with_prefixes(walked.drop("m", "last"), final).select("series_id", "t", "back", "state")
    return packs.mapInPandas(decode, "series_id string, t long, state int")
