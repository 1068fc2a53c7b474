"""Online filter with typed state: rows are put in event-time order before they count.

Each series keeps its posterior and its model as values and the rows that the watermark
has not passed yet as a list. A timer at the earliest of these fires when the watermark
passes it; then all rows before the watermark are applied in the order of (time, seq). So rows
may come late by as much as the watermark allows without changing the result. A row of the
stream may also swap the series' model or reset its posterior, from its own time on.
A batch holds only the rows of one trigger; the state of a series is as large as
what the allowed delay can hold. A series costs few calls of the state store: its posterior and
model are one value, and rows come and go as rows, not as a table for each series.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from latentspark.operators.hmm_kernel import HMMParams, RegimeFilter, validate_params

INPUT = "series_id string, at timestamp, seq long, x double, op string, model string"
OUTPUT = "series_id string, at timestamp, seq long, alpha array<double>, error string"
#: What came of a series in one batch; null ``op`` and ``model``: all observations.
_WAITING = "micros array<long>, seq array<long>, x array<double>, op array<string>, model array<string>"
_APPLIED = "series_id string, micros array<long>, seq array<long>, alpha array<array<double>>, error array<string>"
#: Rows of a series that come out as one.
SLICE = 10_000


def model_text(p: HMMParams) -> str:
    """A model as a column value."""
    return json.dumps([np.asarray(v, dtype=float).tolist() for v in (p.startprob, p.transmat, p.means, p.variances)])


def model_of(text: str) -> HMMParams:
    return validate_params(HMMParams(*(np.array(v) for v in json.loads(text))))


def apply_rows(model: HMMParams, alpha: list[float] | None, started: bool, rows: list[tuple]) -> tuple[list[tuple], HMMParams, list[float], bool]:
    """Applies rows (micros, seq, x, op, model) in order of time and number. ``op`` is 'x' for an observation, 'reset' to
    forget what was before, 'model' to go on under another model. A row that can't be applied gives an error and changes nothing."""
    f = RegimeFilter(model, alpha if started else None)
    out = []
    for micros, seq, x, op, text in sorted(rows, key=lambda r: r[:2]):
        try:
            if op == "reset":
                f.reset()
                alpha_now = f.alpha.tolist()
            elif op == "model":
                new = model_of(text)
                if len(new.startprob) != len(f.params.startprob):
                    raise ValueError("a new model must have as many states")
                f = RegimeFilter(new, f.alpha if f.started else None)
                alpha_now = f.alpha.tolist()
            else:
                alpha_now = f.update(np.array([np.nan if x is None else x])).tolist()
            out.append((micros, seq, alpha_now, None))
        except (ValueError, TypeError) as e:
            out.append((micros, seq, None, str(e)))
    return out, f.params, f.alpha.tolist(), f.started


@lru_cache(256)
def _known_model(text: str) -> HMMParams:
    return model_of(text)


def packed(rows: list[tuple]) -> tuple:
    """Rows (micros, seq, x, op, model) as one of the waiting list."""
    micros, seq, x, op, model = (list(c) for c in zip(*rows, strict=True))
    plain = all(o == "x" for o in op)
    return micros, seq, x, None if plain else op, None if plain else model


def unpacked(waiting: Iterator[tuple]) -> list[tuple]:
    nothing = lambda op, n: [op] * n
    return [r for m, s, x, op, model in waiting for r in zip(m, s, x, op or nothing("x", len(m)), model or nothing(None, len(m)), strict=True)]


class OrderedFilter(StatefulProcessor):
    """The processor of one stream; ``model`` is where series without an initial state start."""

    def __init__(self, model: HMMParams):
        self.start = model_text(validate_params(model))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A null model is the one that the stream starts under.
        self.posterior = handle.getValueState("posterior", "alpha array<double>, started boolean, n long, model string")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(micros, seq, None if x is None or x != x else x, op, model) for _, _, micros, seq, x, op, model in rows]
        if came:
            self.waiting.appendValue(packed(came))
            # One timer a batch; when it fires, all that the watermark has passed is applied.
            self.handle.registerTimer(max(min(r[0] for r in came) // 1000, 0))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = unpacked(self.waiting.get())
        due = [r for r in rows if r[0] // 1000 < passed]
        later = [r for r in rows if r[0] // 1000 >= passed]
        if not due:
            if later:
                self.handle.registerTimer(min(r[0] for r in later) // 1000)
            return
        alpha, started, n, text = self.posterior.get() or (None, False, 0, None)
        out, model, alpha, started = apply_rows(_known_model(text or self.start), None if alpha is None else list(alpha), started, due)
        if any(r[3] == "model" for r in due):
            text = model_text(model)
        self.posterior.update((alpha, started, n + len(due), text))
        if later:
            self.waiting.put([packed(later)])
            self.handle.registerTimer(min(r[0] for r in later) // 1000)
        else:
            self.waiting.clear()
        for k in range(0, len(out), SLICE):
            micros, seq, alphas, errors = (list(c) for c in zip(*out[k : k + SLICE], strict=True))
            yield Row(series_id=key[0], micros=micros, seq=seq, alpha=alphas, error=errors)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        alpha, model = initialState.alpha, initialState.model
        if alpha is not None or model is not None:
            self.posterior.update((None if alpha is None else [float(a) for a in alpha], alpha is not None, 0, model))

    def close(self) -> None:
        pass


def filter_in_order(stream: DataFrame, model: HMMParams, delay: str, initial: DataFrame | None = None) -> DataFrame:
    """(series_id, at, seq, alpha, error) for a stream with the columns ``INPUT``.

    Rows come out once the watermark, ``delay`` behind the latest time seen, has
    passed them; rows that come later than it are dropped by the engine. Null ``op`` means an observation. ``initial`` has
    (series_id, alpha array<double>, model string) of series that go on from somewhere, either null where
    nothing is known. Needs the RocksDB state store."""
    rows = stream.select("series_id", "at", F.unix_micros("at").alias("micros"), "seq", "x", F.coalesce("op", F.lit("x")).alias("op"), "model").where("series_id is not null and at is not null and seq is not null")
    grouped = rows.withWatermark("at", delay).groupBy("series_id")
    start = None if initial is None else initial.select("series_id", "alpha", "model").groupBy("series_id")
    applied = grouped.transformWithState(OrderedFilter(model), _APPLIED, "append", "EventTime", initialState=start)
    each = applied.select("series_id", F.inline(F.arrays_zip("micros", "seq", "alpha", "error")))
    return each.select("series_id", F.timestamp_micros("micros").alias("at"), "seq", "alpha", "error")
