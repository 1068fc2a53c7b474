"""One very long series: Baum-Welch with the series cut into chunks of days.

Step matrices compose, so a chunk's product says what it does to any state
before it. A round of the fit is two jobs: one row of K x K numbers per chunk,
from which the driver derives every chunk's first and last state, and then
each chunk's own recursions and expected counts, summed on the cluster. The
driver holds K * K + 2 K numbers a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators import hmm_kernel as kernel
from latentspark.operators.hmm import observations
from latentspark.operators.hmm_scan import backward_from, product_of


def chunked(series: DataFrame, rows: int = 100_000) -> DataFrame:
    """(chunk, t, x) of a series (t, x), partitioned by chunk and kept."""
    return series.select(F.floor(F.col("t") / rows).cast("long").alias("chunk"), "t", "x").repartition("chunk").persist()


def _products(chunks: DataFrame, p: kernel.HMMParams) -> dict[int, np.ndarray]:
    k = len(p.startprob)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        b, _ = kernel.emissions(p, observations(pdf))
        out = product_of(b, p.transmat)
        if int(pdf["chunk"].iloc[0]):
            out = p.transmat @ out
        out = out / out.sum()
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "m": [out.ravel().tolist()]})

    return {r["chunk"]: np.array(r["m"]).reshape(k, k) for r in chunks.groupBy("chunk").applyInPandas(product, "chunk long, m array<double>").collect()}


def _ends(products: dict[int, np.ndarray], p: kernel.HMMParams) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per chunk the filtered state before it and the backward state after it."""
    order = sorted(products)
    before, after = {}, {}
    a = p.startprob
    for c in order:
        before[c] = a
        a = a @ products[c]
        a = a / a.sum()
    b = np.ones(len(p.startprob))
    for c in reversed(order):
        after[c] = b
        b = products[c] @ b
        b = b / b.sum()
    return {c: (before[c], after[c]) for c in order}


def expected_counts(chunks: DataFrame, p: kernel.HMMParams) -> dict[str, np.ndarray]:
    """The sums that the next parameters follow from, and the log-likelihood."""
    ends = _ends(_products(chunks, p), p)
    last_chunk = max(ends)

    def counts(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["chunk"].iloc[0])
        x = observations(pdf)
        b, top = kernel.emissions(p, x)
        before, after = ends[c]
        prior = before if c == 0 else before @ p.transmat
        alpha, norm = kernel.forward(b, p.transmat, prior)
        beta = backward_from(b, p.transmat, after)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        came = np.vstack([before[None], alpha[:-1]]) if c else alpha[:-1]
        went = (b * beta) if c else (b * beta)[1:]
        scale = np.einsum("ti,ij,tj->t", came, p.transmat, went)
        xi = p.transmat * (came.T @ (went / scale[:, None]))
        stay = gamma[:-1].sum(axis=0) if c == last_chunk else gamma.sum(axis=0)
        row = {
            "ll": float((np.log(norm) + top).sum()), "start": (gamma[0] if c == 0 else np.zeros(len(before))).tolist(), "xi": xi.ravel().tolist(), "support": stay.tolist(),
            "days": gamma.sum(axis=0).tolist(), "sx": (gamma.T @ x).ravel().tolist(), "sxx": (gamma.T @ (x * x)).ravel().tolist(),
        }
        return pd.DataFrame([row])

    names = ("start", "xi", "support", "days", "sx", "sxx")
    got = chunks.groupBy("chunk").applyInPandas(counts, "ll double, " + ", ".join(f"{n} array<double>" for n in names))
    sizes = {"start": len(p.startprob), "xi": p.transmat.size, "support": len(p.startprob), "days": len(p.startprob), "sx": p.means.size, "sxx": p.means.size}
    total = got.agg(F.sum("ll").alias("ll"), *(F.array(*(F.sum(F.col(n)[i]) for i in range(sizes[n]))).alias(n) for n in names)).first()
    return {"ll": total["ll"], **{n: np.array(total[n]) for n in names}}


def fit_long(series: DataFrame, k: int, tol: float = 1e-8, max_iter: int = 500, var_floor: float = 1e-8, rows: int = 100_000) -> tuple[kernel.HMMParams, kernel.HMMFitResult]:
    """:func:`hmm_kernel.fit` for one series (t, x double) of any length; the same
    rounds and rules. Variances come from sums about the pooled mean."""
    q = [(2 * i + 1) / (2 * k) for i in range(k)]
    init = series.agg(F.percentile("x", F.array(*(F.lit(v) for v in q))).alias("q"), F.var_pop("x").alias("v"), F.avg("x").alias("m"), F.count("*").alias("n")).first()
    if init["n"] <= k:
        raise ValueError(f"needs more than {k} observations")
    mid = init["m"]
    chunks = chunked(series.withColumn("x", F.col("x") - mid), rows)
    a = np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(a, 0.9)
    p = kernel.HMMParams(np.full(k, 1.0 / k), a, np.array(init["q"])[:, None] - mid, np.full((k, 1), max(init["v"], var_floor)))
    result = kernel.HMMFitResult(float("nan"), 0, False)
    for _ in range(max_iter):
        s = expected_counts(chunks, p)
        result.loglik_history.append(s["ll"])
        result.n_iter += 1
        if result.n_iter > 1:
            status = kernel.em_step_status(s["ll"], result.loglik_history[-2], tol)
            result.monotone, result.converged = status != kernel.EMStep.NON_MONOTONE, status == kernel.EMStep.CONVERGED
            if status != kernel.EMStep.CONTINUE:
                break
        dead = np.flatnonzero(s["support"] < kernel.DEAD_STATE_SUPPORT)
        if len(dead):
            result.dead_state = int(dead[0])
            break
        means = (s["sx"] / s["days"])[:, None]
        var = np.maximum((s["sxx"] / s["days"])[:, None] - means**2, var_floor)
        trans = s["xi"].reshape(k, k) / s["support"][:, None]
        p = kernel.HMMParams(s["start"] / s["start"].sum(), trans / trans.sum(axis=1, keepdims=True), means, var)
    else:
        result.loglik_history.append(expected_counts(chunks, p)["ll"])
    chunks.unpersist()
    result.log_likelihood = result.loglik_history[-1]
    p.means = p.means + mid
    return kernel.sort_states(p), result
