"""Online regime filter on Structured Streaming.

Each series keeps its posterior, whether it has started and its last sequence
number as keyed state. An observation that is late, repeated, malformed or
without likelihood gives a row with an error and leaves the state as it was.
A batch's rows of a series wait as plain numbers, about forty bytes each, until
all are there and can be put in order; they are applied and given back in slices.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from latentspark.operators.hmm_kernel import HMMParams, RegimeFilter, validate_params

OUTPUT = "series_id string, seq long, alpha array<double>, error string"
STATE = "alpha array<double>, started boolean, last_seq long"
#: Rows of a series that are Python objects at a time.
SLICE = 10_000


def step(params: HMMParams, alpha: list[float] | None, started: bool, last: int, rows: list[tuple]) -> tuple[list[tuple], list[float], bool, int]:
    """Applies rows (seq, x, op) in order to one series' state. ``op`` is 'x' for an observation, 'reset' to forget all before (``x`` may hold a posterior to go on from)."""
    f = RegimeFilter(params, alpha if started else None)
    out = []
    for seq, x, op in sorted(rows, key=lambda r: r[0]):
        if seq <= last:
            out.append((seq, None, f"late: seq {seq} after {last}"))
            continue
        try:
            if op == "reset":
                f.reset(x if x is not None and len(x) == len(params.startprob) else None)
                out.append((seq, f.alpha.tolist(), None))
            else:
                out.append((seq, f.update(np.array([np.nan] if x is None else x, dtype=float)).tolist(), None))
            last = seq
        except ValueError as e:
            out.append((seq, None, str(e)))
    return out, f.alpha.tolist(), f.started, last


def in_order(pdfs: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[list[tuple]]:
    """The rows (seq, x, op) of all ``pdfs`` by seq, equal ones as they came, in slices of ``rows``."""
    seq, length, value, reset = array("q"), array("i"), array("d"), array("b")  # length -1: no x
    for pdf in pdfs:
        x = [None if v is None else np.asarray(v, dtype=float) for v in pdf["x"]]
        seq.extend(int(v) for v in pdf["seq"])
        length.extend(-1 if v is None else len(v) for v in x)
        reset.extend(o == "reset" for o in pdf["op"])
        value.frombytes(np.concatenate([np.empty(0), *(v for v in x if v is not None)]).tobytes())
    seqs, lengths, values = np.frombuffer(seq, np.int64), np.frombuffer(length, np.int32), np.frombuffer(value, np.float64)
    ends = np.cumsum(np.maximum(lengths, 0), dtype=np.int64)
    order = np.argsort(seqs, kind="stable")
    for at in range(0, len(order), rows):
        yield [(seq[k], None if length[k] < 0 else values[ends[k] - length[k] : ends[k]].tolist(), "reset" if reset[k] else "x") for k in order[at : at + rows].tolist()]


def filter_stream(stream: DataFrame, params: HMMParams) -> DataFrame:
    """(series_id, seq, alpha, error) for a stream (series_id string, seq long, x array<double>, op string)."""
    params = validate_params(params)
    table = lambda key, out: pd.DataFrame([(key, *r) for r in out], columns=["series_id", "seq", "alpha", "error"])

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, started, last = state.get if state.exists else (None, False, -1)
        out: list[tuple] = []
        for rows in in_order(pdfs):
            if out:
                yield table(key[0], out)
            out, alpha, started, last = step(params, alpha, started, last, rows)
        state.update((alpha, started, last))
        yield table(key[0], out)

    return stream.select("series_id", "seq", "x", F.coalesce("op", F.lit("x")).alias("op")).groupBy("series_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
