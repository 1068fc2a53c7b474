"""Quality classification by hierarchical empirical Bayes.

A logistic classifier over style features gives each document's evidence (a
log likelihood ratio). Grouped aggregation of the classifier's probabilities
gives each host (``source``) and each path under it (source and language by
default) a beta posterior: a path is shrunk toward its host, a host toward
the corpus, by as many pseudo-documents as the spread between groups
supports. A document's final log odds are its evidence plus the log odds of
its path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latentspark.llm.common import in_small_batches, keyed, sized_broadcast, sliced, written
from latentspark.llm.quality_rules import text_stats

#: Labelled rows, at most, that the classifier is fitted on: those whose id hashes lowest.
MAX_LABELLED = 20_000
FEATURES = 10
#: Bounds of the pseudo-documents that a group is shrunk by.
STRENGTH = (2.0, 1000.0)
_DIGITS, _SHOUT, _STOPS = b"0123456789", b"!?", b".,;:"


def features(text: bytes | None) -> list[float]:
    """Style features of one UTF-8 text; null and empty give the same as no words."""
    n, chars, symbols, dups, repeated, lines, upper = text_stats(text)
    text = text or b""
    words = text.split()
    without = lambda cs: len(text) - len(text.translate(None, cs))
    per = max(chars, 1)
    return [
        float(np.log1p(n)),
        min(chars / max(n, 1), 30.0),
        symbols / per,
        upper / per,
        dups / max(lines, 1),
        repeated / max(n, 1),
        without(_SHOUT) / per,
        without(_DIGITS) / per,
        without(_STOPS) / per,
        len(set(words)) / max(n, 1),
    ]


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its features."""
    for b in sliced(batches):
        x = np.array([features(t) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.float64).reshape(-1, FEATURES)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "x"])


def with_features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("__text"))
    return in_small_batches(rows).mapInArrow(_feature_batches, StructType([*rows.schema.fields[:-1], *StructType.fromDDL("x array<double>").fields]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[list[float], float, float]:
    """Weights and intercept over raw features, and the log odds of the labels.

    Newton steps on standardised features with a ridge. With no rows, or one
    class only, the weights are zero and the odds those of the labels."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    prior = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return [0.0] * FEATURES, prior, prior
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-1] = prior
    penalty = np.diag([ridge] * FEATURES + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p)) @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[:-1] / sd
    return raw.tolist(), float(w[-1] - raw @ mean), prior


def labelled_sample(features_: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled rows, of the ``limit`` labelled ids that hash lowest, which
    are broadcast, so that no features are shuffled. An id's labels, if several, vote; ties and nulls drop out."""
    votes = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("q")).where("q <> 0.5")
    chosen = F.broadcast(votes.orderBy(F.xxhash64("doc_id")).limit(limit))
    rows = features_.where("doc_id is not null").join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("h"), "x", (F.col("q") > 0.5).cast("double").alias("y"))
    got = rows.orderBy("h").limit(limit).toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, FEATURES)
    return x, got["y"].to_numpy(dtype=np.float64)


def _labelled_rows(train: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(doc_id, x) of the rows of ``train`` with one of the ``limit`` labelled ids that hash lowest; so many are broadcast at most."""
    ids = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(limit)
    rows = train.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "doc_id")
    return with_features(rows, "t", ["doc_id"])


def _score(x: Column, weights: list[float], intercept: float) -> Column:
    total = F.lit(intercept)
    for k, w in enumerate(weights):
        total = total + x[k] * F.lit(w)
    return F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))


def _strength(groups: DataFrame, mean: str) -> float:
    """Pseudo-documents of a beta prior by moments: the variance between the
    groups' means beyond what documents within a group explain."""
    rate = F.col("s") / F.col("n")
    got = (
        groups.where("n >= 5")
        .agg(
            F.sum(F.col("n") * (rate - F.col(mean)) * (rate - F.col(mean))).alias("between"),
            F.sum(F.col(mean) * (1 - F.col(mean))).alias("within"),
            F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("binomial"),
            F.sum("n").alias("n"),
            F.count("*").alias("groups"),
        )
        .first()
    )
    if not got["groups"] or got["groups"] < 2:
        return STRENGTH[1]
    excess = (got["between"] - got["within"]) / got["n"]
    spread = got["binomial"] / got["n"]
    return STRENGTH[1] if excess <= 0 else float(min(max(spread / excess - 1, STRENGTH[0]), STRENGTH[1]))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate) from rows (host, path, p)."""
    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    rate = (total["s"] or 0.0) / (total["n"] or 1)
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("rate", F.lit(float(rate)))
    m = _strength(hosts, "rate")
    hosts = hosts.select("host", ((F.col("s") + m * rate) / (F.col("n") + m)).alias("host_rate"))
    nested = paths.join(hosts, "host")
    k = _strength(nested, "host_rate")
    return written(nested.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), "sites")


def _judge(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float, limit: int, cols: dict, labelled: DataFrame | None = None) -> DataFrame:
    rows = docs.withColumn("host", keyed(cols["host"])).withColumn("path", keyed(cols["path"])).withColumn("doc_id", F.col(cols["id"]).cast("long"))
    found = written(with_features(rows, cols["text"], ["doc_id", "host", "path"]), "features")
    weights, intercept, prior = fit_logistic(*labelled_sample(found if labelled is None else labelled, labels, limit))
    p = lambda df: 1 / (1 + F.exp(-_score(df["x"], weights, intercept)))
    sites = site_posteriors(found.select("host", "path", p(found).alias("p")))
    base = found if not keep else with_features(rows, cols["text"], [*keep, "host", "path"])
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    return (
        base.withColumn("evidence", _score(base["x"], weights, intercept) - prior)
        .join(sized_broadcast(sites), ["host", "path"])
        .withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("path_rate"))))))
        .withColumn("kept", F.col("quality") >= threshold)
    )


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, host_rate, path_rate, quality, kept.

    ``labels`` has doc_id and quality (0 or 1). Null or empty texts have the
    features of no words; null hosts and paths are groups of their own; a host
    with one document leans on the corpus. Without labels the evidence is 0
    and all documents share one probability. Very long texts are read whole; a
    quality equal to ``threshold`` is kept. Repeated rows each count; null ids
    stay null and have no label. Other columns are ignored, whatever their
    names; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(host_col).alias("h"), F.col(path_col).alias("p"))
    cols = {"id": "i", "text": "t", "host": "h", "path": "p"}
    return _judge(rows, labels, [], threshold, limit, cols).select("doc_id", "evidence", "host_rate", "path_rate", "quality", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", train: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose quality reaches ``threshold``, with their own columns only.

    The classifier is fitted on labelled rows of ``train``, by default ``docs``;
    documents that were filtered before may hold no bad example any more. Null
    and empty texts, nulls elsewhere, ties, very long texts and repeated rows as
    in :func:`score`; an empty table stays empty."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(host_col).alias("h"), F.col(path_col).alias("p"))
    cols = {"id": "i", "text": "t", "host": "h", "path": "p"}
    labelled = None if train is None else _labelled_rows(train, labels, id_col, text_col, limit)
    return _judge(rows, labels, ["__row"], threshold, limit, cols, labelled).where("kept").select("__row.*")
