"""Hidden Markov models over many series at once: (series_id, t, x) with x a
double or an array of one or two doubles. Each series (and number of states)
is one group; its recursions are array code, everything else is relational."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from latentspark.functions import checks
from latentspark.operators import hmm_kernel as kernel

PARAMS = "startprob array<double>, transmat array<array<double>>, means array<array<double>>, variances array<array<double>>"
FIT = f"k int, {PARAMS}, log_likelihood double, n_iter int, converged boolean, monotone boolean, dead_state int, n_obs long, error string, loglik_history array<double>"


def observations(pdf: pd.DataFrame) -> np.ndarray:
    """A group's observations in day order, as (T, D)."""
    x = pdf.sort_values("t", kind="stable")["x"]
    return np.stack(x.to_numpy()).astype(float) if len(x) and isinstance(x.iloc[0], (list, np.ndarray)) else x.to_numpy(dtype=float)[:, None]


def params_of(row: object) -> kernel.HMMParams:
    """Parameters from a row with the columns of ``PARAMS``."""
    two = lambda v: np.array([list(x) for x in v], dtype=float)
    return kernel.HMMParams(np.array(row["startprob"], dtype=float), two(row["transmat"]), two(row["means"]), two(row["variances"]))


def _id_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def fit_hmm(series: DataFrame, states: Sequence[int] = (3,), tol: float = 1e-8, max_iter: int = 500, var_floor: float = 1e-8, key: str = "series_id") -> DataFrame:
    """One row per series and number of states; a series that can't be fitted has an ``error`` instead of parameters."""

    names = [c.split()[0] for c in FIT.split(", ")]

    def fit(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, row = int(group[1]), dict.fromkeys([key, *names]) | {key: group[0], "k": int(group[1]), "n_obs": len(pdf)}
        try:
            p, r = kernel.fit(observations(pdf), k, tol, max_iter, var_floor)
            row |= {"startprob": p.startprob.tolist(), "transmat": p.transmat.tolist(), "means": p.means.tolist(), "variances": p.variances.tolist()}
            row |= {"log_likelihood": r.log_likelihood, "n_iter": r.n_iter, "converged": r.converged, "monotone": r.monotone, "dead_state": r.dead_state, "loglik_history": r.loglik_history}
        except ValueError as e:
            row["error"] = str(e)
        return pd.DataFrame([row])

    rows = series.select(key, "t", "x", F.explode(F.array(*(F.lit(int(k)) for k in states))).alias("k"))
    return rows.groupBy(key, "k").applyInPandas(fit, f"{key} {_id_type(series, key)}, {FIT}")


def _per_series(series: DataFrame, models: DataFrame, out: str, make, key: str) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[key, "t", *(c.split()[0] for c in out.split(", "))])
        left = left.sort_values("t", kind="stable")
        p = kernel.validate_params(params_of(right.iloc[0]))
        got = make(p, observations(left))
        return pd.DataFrame({key: left[key].to_numpy(), "t": left["t"].to_numpy(), **got})

    return (
        series.select(key, "t", "x").groupBy(key).cogroup(models.select(key, *(c.split()[0] for c in PARAMS.split(", "))).groupBy(key))
        .applyInPandas(run, f"{key} {_id_type(series, key)}, t int, {out}")
    )


def filtered_probabilities(series: DataFrame, models: DataFrame, key: str = "series_id") -> DataFrame:
    return _per_series(series, models, "p array<double>", lambda p, x: {"p": list(kernel.filtered(p, x))}, key)


def smoothed_probabilities(series: DataFrame, models: DataFrame, key: str = "series_id") -> DataFrame:
    return _per_series(series, models, "p array<double>", lambda p, x: {"p": list(kernel.smoothed(p, x))}, key)


def decode(series: DataFrame, models: DataFrame, key: str = "series_id") -> DataFrame:
    """Viterbi path (series, t, state)."""
    return _per_series(series, models, "state int", lambda p, x: {"state": kernel.viterbi(p, x).astype("int32")}, key)


def log_likelihood(series: DataFrame, models: DataFrame, key: str = "series_id") -> DataFrame:
    got = _per_series(series, models, "ll double", lambda p, x: {"ll": np.r_[kernel.score(p, x), np.zeros(len(x) - 1)]}, key)
    return got.groupBy(key).agg(F.sum("ll").alias("log_likelihood"))


def emission_log_density(x: Column, means: Column, variances: Column) -> Column:
    """Log densities of one observation (array of D) under every state, as an array of K."""
    one = lambda mu, var: F.aggregate(
        F.transform(mu, lambda m, d: -0.5 * (F.log(F.lit(2 * np.pi)) + F.log(F.get(var, d)) + (F.get(x, d) - m) * (F.get(x, d) - m) / F.get(var, d))), F.lit(0.0), lambda a, v: a + v
    )
    return F.zip_with(means, variances, one)


def stationary_distribution(models: DataFrame, key: str = "series_id") -> DataFrame:
    """(series, k, state, share) by the power method."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                pi = kernel.stationary(np.array([list(x) for x in r["transmat"]]))
                rows += [(r[key], r["k"], i, float(v)) for i, v in enumerate(pi)]
            yield pd.DataFrame(rows, columns=[key, "k", "state", "share"])

    return models.where("transmat is not null").select(key, "k", "transmat").mapInPandas(batches, f"{key} {_id_type(models, key)}, k int, state int, share double")


def information_criteria(models: DataFrame) -> DataFrame:
    """Adds n_params, aic and bic."""
    dim = F.size(F.element_at("means", 1))
    n = 2 * F.col("k") * dim + F.col("k") * (F.col("k") - 1) + F.col("k") - 1
    return models.withColumn("n_params", n).withColumn("aic", -2 * F.col("log_likelihood") + 2 * n).withColumn("bic", -2 * F.col("log_likelihood") + n * F.log(F.col("n_obs").cast("double")))


def bic_table(series: DataFrame, states: Sequence[int] = (1, 2, 3, 4), key: str = "series_id", **settings) -> DataFrame:
    """(series, k, n_params, log_likelihood, bic). One state is the closed form of a Gaussian; the others are fitted side by side."""
    out = []
    if 1 in states:
        x = F.element_at("x", 1) if isinstance(series.schema["x"].dataType, ArrayType) else F.col("x")
        n, v = F.count("*"), F.var_pop(x)
        ll = -0.5 * n * (F.log(2 * np.pi * v) + 1.0)
        out.append(series.groupBy(key).agg(F.lit(1).alias("k"), F.lit(2).alias("n_params"), ll.alias("log_likelihood"), (-2 * ll + 2 * F.log(n.cast("double"))).alias("bic")))
    if more := [k for k in states if k > 1]:
        out.append(information_criteria(fit_hmm(series, more, key=key, **settings)).select(key, "k", "n_params", "log_likelihood", "bic"))
    got = out[0]
    for df in out[1:]:
        got = got.unionByName(df)
    return got


def regime_table(models: DataFrame, key: str = "series_id") -> DataFrame:
    """(series, k, state, ann_mean, ann_vol, share, duration, name): states described per year; named calm, choppy and crisis by variance."""
    each = models.where("means is not null").select(key, "k", F.posexplode(F.arrays_zip("means", "variances", "transmat")).alias("state", "s"), F.expr("transform(variances, v -> v[0])").alias("vs"))
    var, stay = F.col("s.variances")[0], F.get("s.transmat", F.col("state"))
    name = F.when(var == F.array_max("vs"), "crisis").when(var == F.array_min("vs"), "calm").otherwise("choppy")
    rows = each.select(key, "k", "state", (252.0 * F.col("s.means")[0]).alias("ann_mean"), F.sqrt(252.0 * var).alias("ann_vol"), F.when(stay < 1.0, 1.0 / (1.0 - stay)).alias("duration"), name.alias("name"))
    return rows.join(stationary_distribution(models, key), [key, "k", "state"])


def transition_rows(models: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, k, state, to_state, p): the rows of every model's transition matrix."""
    rows = models.select(key, "k", F.posexplode("transmat").alias("state", "row"))
    return rows.select(key, "k", "state", F.posexplode("row").alias("to_state", "p"))


def viterbi_accuracy(path: DataFrame, truth: DataFrame, models: DataFrame) -> DataFrame:
    """(accuracy): share of days whose decoded state is the true one's: 0 calm (least variance), 2 crisis (greatest), 1 the other."""
    v = models.select(F.posexplode(F.expr("transform(variances, v -> v[0])")).alias("k", "v"))
    pick = v.agg(F.min_by("k", F.struct("v", "k")).alias("calm"), F.max_by("k", F.struct(F.col("v"), (-F.col("k")).alias("low"))).alias("crisis"))
    mapped = truth.crossJoin(F.broadcast(pick)).withColumn("want", F.when(F.col("state") == 0, F.col("calm")).when(F.col("state") == 2, F.col("crisis")).otherwise(3 - F.col("calm") - F.col("crisis")))
    return path.select("t", F.col("state").alias("got")).join(mapped, "t").agg(F.avg(F.when(F.col("got") == F.col("want"), 1.0).otherwise(0.0)).alias("accuracy"))


def regime_gate_report(series: DataFrame, key: str = "series_id", **settings) -> tuple[DataFrame, DataFrame]:
    """Walk-forward gate of every series (series, t, x): days (series, t, gate,
    p_calm, refit_t) and models (series, refit_t, parameters, fit, calm_state, tripped).

    A series is walked once: its models stand in the rows of their refit days,
    and the table is kept, a row per day."""
    fits = f"{PARAMS}, log_likelihood double, n_iter int, converged boolean, monotone boolean, dead_state int, calm_state int, tripped boolean"
    names = [c.split()[0] for c in fits.split(", ")]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        r = hmm_walk(pdf["x"].to_numpy(dtype=float))
        at = {
            t: (p.startprob.tolist(), p.transmat.tolist(), p.means.tolist(), p.variances.tolist(), f.log_likelihood, f.n_iter, f.converged, f.monotone, f.dead_state, calm, trip)
            for t, p, f, calm, trip in r.models
        }
        none = (None,) * len(names)
        model = pd.DataFrame([at.get(k, none) for k in range(len(pdf))], columns=names, dtype=object)
        days = pd.DataFrame({key: pdf[key].to_numpy(), "t": pdf["t"].to_numpy(), "gate": r.gate, "p_calm": r.p_calm, "refit_t": r.refit_t})
        return pd.concat([days, model], axis=1)

    hmm_walk = partial(kernel.walk_forward, **settings)
    got = series.select(key, "t", "x").groupBy(key).applyInPandas(walk, f"{key} {_id_type(series, key)}, t int, gate double, p_calm double, refit_t int, {fits}").persist()
    return got.select(key, "t", "gate", "p_calm", "refit_t"), got.where("tripped is not null").select(key, "refit_t", *names)


def regime_gate(series: DataFrame, key: str = "series_id", **settings) -> DataFrame:
    return regime_gate_report(series, key, **settings)[0].select(key, "t", "gate")


def register_udtf(spark, name: str = "fit_hmm") -> None:
    """SQL table function: ``select * from fit_hmm(table(s) partition by series_id order by t)``, s being (series_id string, t, x), with an optional second argument, the number of states, of which a series' first row counts. A series that can't be fitted is a row with its error."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="series_id string, state int, mean double, variance double, log_likelihood double, error string")
    class FitHmm:
        def __init__(self):
            self.key, self.x, self.k = None, [], None

        def eval(self, row, k=3):
            if self.k is None:
                self.key, self.k = row["series_id"], k
            self.x.append(row["x"])

        def terminate(self):
            if not self.x:
                return
            try:
                p, r = kernel.fit(self.x, self.k)
            except (ValueError, TypeError) as e:
                yield self.key, None, None, None, None, str(e)
                return
            for i in range(self.k):
                yield self.key, i, float(p.means[i, 0]), float(p.variances[i, 0]), r.log_likelihood, None

    spark.udtf.register(name, FitHmm)


def valid_params() -> Column:
    """Whether the columns of ``PARAMS`` hold a model."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    distribution = lambda v: F.forall(v, lambda x: ok(x) & (x >= 0.0)) & (F.abs(total(v) - 1.0) <= kernel.STOCHASTIC_TOL)
    each = lambda m, rule: F.forall(m, lambda row: F.forall(row, rule))
    k = F.size("startprob")
    shapes = (F.size("transmat") == k) & (F.size("means") == k) & (F.size("variances") == k) & F.forall("transmat", lambda row: F.size(row) == k)
    found = shapes & distribution(F.col("startprob")) & F.forall("transmat", distribution) & each(F.col("means"), ok) & each(F.col("variances"), lambda x: ok(x) & (x > 0.0))
    return F.coalesce(found, F.lit(False))


class GaussianHMM:
    """Settings of a diagonal-Gaussian model, fitted to every series of a table at once."""

    def __init__(self, n_states: int = 3, tol: float = 1e-8, max_iter: int = 500, var_floor: float = 1e-8, key: str = "series_id"):
        if isinstance(n_states, bool) or not isinstance(n_states, int) or n_states < 2 or not tol > 0 or not var_floor > 0 or max_iter < 1:
            raise ValueError("needs n_states >= 2 and positive tol, var_floor and max_iter")
        self.n_states, self.tol, self.max_iter, self.var_floor, self.key = n_states, tol, max_iter, var_floor, key
        self.models: DataFrame | None = None

    def fit(self, series: DataFrame) -> GaussianHMM:
        self.models = fit_hmm(series, (self.n_states,), self.tol, self.max_iter, self.var_floor, self.key).persist()
        return self

    def set_params(self, models: DataFrame) -> GaussianHMM:
        """Uses given parameters, a row per series with the columns of ``PARAMS``; raises ValueError naming the first series whose are not a model's."""
        checks.first_offender(models, ~valid_params(), [self.key], "startprob and rows of transmat must be distributions, means finite and variances > 0")
        self.models = models
        return self

    def _fitted(self) -> DataFrame:
        if self.models is None:
            raise ValueError("the model is not fitted")
        return self.models

    def score(self, series: DataFrame) -> DataFrame:
        return log_likelihood(series, self._fitted(), self.key)

    def filtered_probabilities(self, series: DataFrame) -> DataFrame:
        return filtered_probabilities(series, self._fitted(), self.key)

    def smoothed_probabilities(self, series: DataFrame) -> DataFrame:
        return smoothed_probabilities(series, self._fitted(), self.key)

    def viterbi(self, series: DataFrame) -> DataFrame:
        return decode(series, self._fitted(), self.key)

    def stationary_distribution(self) -> DataFrame:
        return stationary_distribution(self._fitted(), self.key)

    def information_criteria(self) -> DataFrame:
        return information_criteria(self._fitted())
