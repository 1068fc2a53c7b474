"""Evaluation of gates and books. Sweeps are columns, not loops: a cost, a lag
or a gate is part of the run's key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from latentspark.functions import checks
from latentspark.functions.windows import DAYS
from latentspark.operators import gates, ranks
from latentspark.operators.backtest import compute_metrics, flows, sharpe_of
from latentspark.sources.scratch import sized, written


def sharpe(daily: DataFrame, value: str = "net") -> DataFrame:
    return daily.groupBy("run_id").agg(sharpe_of(F.avg(value), F.stddev_pop(value)).alias("sharpe"))


def window_metrics(daily: DataFrame, start: int, dates: DataFrame | None = None) -> DataFrame:
    """Metrics of the days from ``start`` on; equity restarts at 1."""
    checks.scalar(start >= 0, f"start must be >= 0, got {start}")
    return compute_metrics(daily.where(F.col("t") >= start), dates)


def annual_turnover(daily: DataFrame, start: int = 0) -> DataFrame:
    return daily.where(F.col("t") >= start).groupBy("run_id").agg((DAYS * F.avg("turnover")).alias("annual_turnover"))


def build_book(positions: DataFrame, returns: DataFrame, gate_set: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, run_id, t, gross, turnover) of the 50/50 book under every gate of
    ``gate_set`` (keys, series_id, t, gate), cost-free: net at any cost follows,
    being linear in it. ``positions`` and ``returns`` have a run_id per sleeve."""
    names = gate_set.select(*keys, F.col("series_id").alias("gate_id"), "t", "gate")
    gated = positions.join(names, [*keys, "t"]).select(*keys, "gate_id", F.col("run_id").alias("sleeve"), "t", "asset_idx", (F.col("p") * F.col("gate")).alias("p"))
    r = returns.withColumnRenamed("run_id", "sleeve")
    rows = gated.withColumn("prev", F.coalesce(F.lag("p").over(Window.partitionBy(*keys, "gate_id", "sleeve", "asset_idx").orderBy("t")), F.lit(0.0)))
    return (
        rows.join(r, [*keys, "sleeve", "t", "asset_idx"]).groupBy(*keys, F.col("gate_id").alias("run_id"), "t")
        .agg((0.5 * F.sum(F.col("prev") * F.col("r"))).alias("gross"), (0.5 * F.sum(F.abs(F.col("p") - F.col("prev")))).alias("turnover"))
    )


def net(stream: DataFrame, cost_bps: float) -> DataFrame:
    return stream.withColumn("net", F.col("gross") - cost_bps / 1e4 * F.col("turnover"))


def moments(stream: DataFrame, start: int = 0) -> DataFrame:
    """Per run the five moments from which the Sharpe at any cost follows."""
    return stream.where(F.col("t") >= start).groupBy("run_id").agg(
        F.avg("gross").alias("mg"), F.avg("turnover").alias("mt"), F.var_pop("gross").alias("vg"), F.covar_pop("gross", "turnover").alias("cov"), F.var_pop("turnover").alias("vt")
    )


def sharpe_at_cost(c: Column) -> Column:
    """Over the columns of :func:`moments`; ``c`` is the cost as a fraction."""
    var = F.greatest(F.col("vg") - 2.0 * c * F.col("cov") + c * c * F.col("vt"), F.lit(0.0))
    return F.when(var > 0.0, math.sqrt(DAYS) * (F.col("mg") - c * F.col("mt")) / F.sqrt(var)).otherwise(0.0)


def cost_sweep(stream: DataFrame, costs_bps: Sequence[float], start: int = 0) -> DataFrame:
    """(run_id, cost_bps, sharpe): one scan for all costs."""
    grid = F.explode(F.array(*(F.lit(float(c)) for c in costs_bps))).alias("cost_bps")
    return moments(stream, start).select("*", grid).select("run_id", "cost_bps", sharpe_at_cost(F.col("cost_bps") / 1e4).alias("sharpe"))


def lag_sweep(positions: DataFrame, returns: DataFrame, gate: DataFrame, lags: Sequence[int], cost_bps: float, start: int = 0) -> DataFrame:
    """(run_id, lag, sharpe) of the book under the gates, each ``lag`` days late."""
    late = None
    for n in lags:
        one = gates.lag_gate(gate, n).withColumn("series_id", F.concat_ws("@", "series_id", F.lit(str(n))))
        late = one if late is None else late.unionByName(one)
    got = sharpe(net(build_book(positions, returns, late), cost_bps).where(F.col("t") >= start))
    part = F.split("run_id", "@")
    return got.select(part[0].alias("run_id"), part[1].cast("int").alias("lag"), "sharpe")


@dataclass(frozen=True)
class BreakEven:
    status: str
    cost_bps: float


def break_even_cost(edge: Callable[[float], float], low: float = 0.0, high: float = 100.0, tol: float = 1e-4) -> BreakEven:
    """The cost at which ``edge`` falls to 0, by bisection; NaN unless crossed."""
    checks.scalar(low < high and tol > 0.0, "needs low < high and tol > 0")
    if not edge(low) > 0.0:
        return BreakEven("below_at_zero", math.nan)
    if edge(high) > 0.0:
        return BreakEven("above_at_max", math.nan)
    while high - low > tol:
        mid = 0.5 * (low + high)
        low, high = (mid, high) if edge(mid) > 0.0 else (low, mid)
    return BreakEven("crossed", 0.5 * (low + high))


def gate_break_even(stream: DataFrame, gated: str, ungated: str, start: int = 0, both_pay: bool = True, **kw) -> BreakEven:
    """Cost at which the gated run's Sharpe falls to the ungated one's. Two rows of moments reach the driver."""
    m = {r["run_id"]: r.asDict() for r in moments(stream.where(F.col("run_id").isin(gated, ungated)), start).collect()}

    return break_even_cost(lambda bps: sharpe_of_moments(m[gated], bps) - sharpe_of_moments(m[ungated], bps if both_pay else 0.0), **kw)


def sharpe_of_moments(m: dict, bps: float) -> float:
    """:func:`sharpe_at_cost` of one run's moments."""
    c = bps / 1e4
    var = max(m["vg"] - 2 * c * m["cov"] + c * c * m["vt"], 0.0)
    return math.sqrt(DAYS) * (m["mg"] - c * m["mt"]) / math.sqrt(var) if var > 0 else 0.0


def _draws(seed: int, replicate: int, block: int) -> tuple[float, float]:
    """Two numbers in [0, 1) from the digest of ``seed:replicate:block``, the same in every engine that has md5."""
    digest = hashlib.md5(f"{seed}:{replicate}:{block}".encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) / 2.0**32, int(digest[8:16], 16) / 2.0**32


def blocks_needed(n: int, mean_block: float) -> int:
    """Blocks drawn for a replicate: the expected number and six standard deviations; the last one fills what may be left."""
    expected = n / mean_block
    return min(n, math.ceil(expected + 6.0 * math.sqrt(expected) + 10.0))


def stationary_bootstrap_blocks(n: int, mean_block: float, seed: int, replicate: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the blocks that cover ``n`` days in one replicate: starts uniform, lengths geometric, the last one cut."""
    starts, lengths, total, most = [], [], 0, blocks_needed(n, mean_block)
    for block in range(most):
        u, v = _draws(seed, replicate, block)
        k = 1 if mean_block <= 1.0 else 1 + int(math.log(1.0 - v) / math.log(1.0 - 1.0 / mean_block))
        k = n - total if block == most - 1 else min(k, n - total)
        starts.append(int(u * n))
        lengths.append(k)
        total += k
        if total == n:
            break
    return np.array(starts), np.array(lengths)


def stationary_bootstrap_indices(n: int, n_boot: int, mean_block: float, seed: int) -> np.ndarray:
    """(n_boot, n) resampled days, wrapping at the end."""
    checks.scalar(n >= 1 and n_boot >= 1 and mean_block >= 1.0, "n, n_boot and mean_block must be >= 1")
    out = np.empty((n_boot, n), dtype=np.int64)
    for b in range(n_boot):
        s, k = stationary_bootstrap_blocks(n, mean_block, seed, b)
        out[b] = np.concatenate([(x + np.arange(y)) % n for x, y in zip(s, k, strict=True)])
    return out


def bootstrap_block_rows(replicates: DataFrame, mean_block: float, seed: int) -> DataFrame:
    """(run_id, n, replicate, start, stop) of every block of ``replicates`` (run_id, n, replicate).

    The draws are those of :func:`stationary_bootstrap_blocks` as column
    expressions: uniforms from a digest, geometric lengths by their inverse, ends by a running sum."""
    n, block = F.col("n"), F.col("block")
    expected = n / F.lit(float(mean_block))
    most = F.least(n, F.ceil(expected + 6.0 * F.sqrt(expected) + 10.0))
    rows = replicates.select("run_id", "n", "replicate", most.alias("most"), F.explode(F.sequence(F.lit(0), (most - 1).cast("int"))).alias("block"))
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "block")))
    unit = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("double") / 2.0**32
    drawn = F.lit(1.0) if mean_block <= 1.0 else 1.0 + F.floor(F.log(1.0 - unit(9)) / math.log(1.0 - 1.0 / mean_block))
    length = F.when(block == F.col("most") - 1, n).otherwise(F.least(drawn.cast("long"), n))
    so_far = Window.partitionBy("run_id", "replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.select("run_id", "n", "replicate", "block", F.floor(unit(1) * n).alias("start"), length.alias("length")).withColumn("done", F.coalesce(F.sum("length").over(so_far), F.lit(0)))
    left = n - F.col("done")
    return ends.where(left > 0).select("run_id", "n", "replicate", "start", (F.col("start") + F.least("length", left)).alias("stop"))


def paired_block_bootstrap(pairs: DataFrame, n_boot: int = 10_000, mean_block: float = 21.0, level: float = 0.95, seed: int = 83) -> DataFrame:
    """One row per pair of runs (run_id, t, a, b): Sharpe difference a - b, its
    percentile interval, standard error and share of positive replicates.

    A draw depends on (seed, replicate, block) alone, so results don't depend on
    partitioning and SQL can repeat them. Replicates are dealt over the cluster; a
    replicate's sums are differences of running sums at its blocks' ends, which are
    looked up where the blocks are made while the counted running sums are small enough to broadcast."""
    checks.scalar(n_boot >= 1 and mean_block >= 1.0 and 0.0 < level < 1.0, "needs n_boot >= 1, mean_block >= 1 and 0 < level < 1")
    powers = {"a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b")}
    by_day = Window.partitionBy("run_id").orderBy("t")
    running = written(
        pairs.select("run_id", F.row_number().over(by_day).cast("long").alias("at"), *(F.sum(v).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(k) for k, v in powers.items())),
        "running-sums",
    )
    sizes = running.groupBy("run_id").agg(F.max("at").alias("n"), *(F.max_by(k, "at").alias(f"all_{k}") for k in powers))
    replicates = sizes.select("run_id", "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate")).repartition("run_id", "replicate")
    start, stop, n = F.col("start"), F.col("stop"), F.col("n")
    # A block that passes the last day goes on from the first; the sums before day 1 are 0.
    cuts = F.array(F.struct(start.alias("at"), F.lit(-1.0).alias("sign")), F.struct(F.least(stop, n).alias("at"), F.lit(1.0).alias("sign")), F.struct((stop - n).alias("at"), F.lit(1.0).alias("sign")))
    ends = bootstrap_block_rows(replicates, mean_block, seed).select("run_id", "n", "replicate", F.inline(cuts)).where("at > 0")
    mean = lambda k: (F.sum(F.col("sign") * F.col(k)) / F.col("n")).alias(k)
    sums = ends.join(sized(running), ["run_id", "at"]).groupBy("run_id", "replicate", "n").agg(*map(mean, powers))
    spread = lambda k: F.sqrt(F.greatest(F.col(k + k) - F.col(k) * F.col(k), F.lit(0.0)))
    diffs = sums.select("run_id", "replicate", (sharpe_of(F.col("a"), spread("a")) - sharpe_of(F.col("b"), spread("b"))).alias("diff"))
    q = F.percentile("diff", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    boot = diffs.groupBy("run_id").agg(q[0].alias("low"), q[1].alias("high"), F.stddev_samp("diff").alias("std_error"), F.avg(F.when(F.col("diff") > 0, 1.0).otherwise(0.0)).alias("p_positive"), F.count("*").alias("n_boot"))
    point = pairs.groupBy("run_id").agg((sharpe_of(F.avg("a"), F.stddev_pop("a")) - sharpe_of(F.avg("b"), F.stddev_pop("b"))).alias("diff"))
    return point.join(boot, "run_id")


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score", *keys: str) -> DataFrame:
    """(keys, auc): Mann-Whitney with average ranks; NaN where one class is missing.

    Without keys ranks come from a range partition (:mod:`ranks`); with keys each
    key's distinct scores, counted by class, are one window."""
    if not keys:
        return ranks.roc_auc(rows, label, score)
    counted = rows.groupBy(*keys, F.col(score).alias("__s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("boolean").cast("long")).alias("y"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0
    got = counted.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.col("y") * F.col("__r")).alias("s"), F.sum("y").cast("double").alias("n1"), F.sum(F.col("n") - F.col("y")).cast("double").alias("n0"))
    auc = F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))).otherwise(float("nan"))
    return got.select(*keys, auc.alias("auc"))


def classification_report(states: DataFrame, gate: DataFrame, start: int, threshold: float = 0.5, calm: int = 0, crisis: int = 2, key: str = "series_id") -> DataFrame:
    """One row per series: accuracy of calm calls, accuracy of the majority, both
    AUCs, and how many crisis episodes there are, are missed, and how late
    the others are called (the gate below the threshold), in days."""
    day = states.join(gate, [key, "t"]).where(F.col("t") >= start).withColumn("calm", F.col("state") == calm).withColumn("crisis", F.col("state") == crisis)
    said = F.col("gate") >= threshold
    base = day.groupBy(key).agg(F.avg((said == F.col("calm")).cast("double")).alias("accuracy"), F.avg(F.col("calm").cast("double")).alias("share"), F.count("*").alias("n_days"))
    base = base.withColumn("majority_accuracy", F.greatest("share", 1.0 - F.col("share"))).drop("share")
    calm_auc = roc_auc(day.select(key, F.col("calm").alias("label"), F.col("gate").alias("score")), "label", "score", key).withColumnRenamed("auc", "calm_auc")
    crisis_auc = roc_auc(day.select(key, F.col("crisis").alias("label"), (-F.col("gate")).alias("score")), "label", "score", key).withColumnRenamed("auc", "crisis_auc")
    ep = gates.crisis_episodes(states, start, crisis, key)
    called = gate.where(F.col("gate") < threshold).select(F.col(key).alias("k"), F.col("t").alias("at"))
    first = ep.join(called, (F.col(key) == F.col("k")) & (F.col("at") >= F.col("first_t")) & (F.col("at") < F.col("end_t")), "left").groupBy(key, "first_t").agg((F.min("at") - F.col("first_t")).alias("lag"))
    lags = first.groupBy(key).agg(F.count("*").alias("episodes"), F.sum(F.col("lag").isNull().cast("int")).alias("missed"), F.percentile("lag", F.lit(0.5)).alias("median_lag"), F.avg("lag").alias("mean_lag"))
    return base.join(calm_auc, key).join(crisis_auc, key).join(lags, key, "left").fillna(0, ["episodes", "missed"])


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share."""
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def percentile_of(rows: DataFrame, value: str, x: float) -> DataFrame:
    return rows.agg(F.avg((F.col(value) <= x).cast("double")).alias("share"))


def break_even(rows: DataFrame, gated: str, ungated: str, **kw) -> DataFrame:
    """Adds break_even and break_even_status to rows that hold the
    :func:`moments` of both runs as structs ``gated`` and ``ungated``, both paying the cost."""

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [break_even_cost(lambda bps, a=a, b=b: sharpe_of_moments(a, bps) - sharpe_of_moments(b, bps), **kw) for a, b in zip(pdf[gated], pdf[ungated], strict=True)]
            yield pdf.drop(columns=[gated, ungated]).assign(break_even=[x.cost_bps for x in found], break_even_status=[x.status for x in found])

    rest = [f for f in rows.schema.fields if f.name not in (gated, ungated)]
    schema = StructType([*rest, StructField("break_even", DoubleType()), StructField("break_even_status", StringType())])
    return rows.mapInPandas(search, schema)


def summarise_paths(paths: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Per scenario: paths that ran and failed, mean and sample sd of each Sharpe
    named in ``pairs``, and how often the first beats the second, with its Wilson interval.
    Failed paths are rows with an ``error``."""
    ok = F.col("error").isNull()
    aggs = [F.sum(ok.cast("int")).alias("n_ok"), F.sum((~ok).cast("int")).alias("n_failed")]
    names = list(dict.fromkeys(x for p in pairs for x in p))
    for c in names:
        aggs += [F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}"), F.stddev_samp(F.when(ok, F.col(c))).alias(f"sd_{c}")]
    aggs += [F.sum(F.when(ok, (F.col(a) > F.col(b)).cast("int"))).alias(f"wins_{a}_{b}") for a, b in pairs]
    got = paths.groupBy("scenario").agg(*aggs)
    for a, b in pairs:
        low, high = wilson(F.col(f"wins_{a}_{b}").cast("double"), F.col("n_ok").cast("double"))
        got = got.withColumn(f"low_{a}_{b}", low).withColumn(f"high_{a}_{b}", high)
    return got
