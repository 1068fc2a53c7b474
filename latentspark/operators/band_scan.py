"""The no-trade band over series of any length, as an ordered scan of functions.

What is held follows ``g`` when it is further than the band from what was held before,
else stays. As a function of what was held before a chunk, what is held after it
is that value itself while no ``g`` of the chunk is too far from it, and else what the chunk makes of the first ``g`` that is.
That first one is a new high or a new low of the chunk, so a function is two short
lists of records, each with the value at the chunk's end that it leads to. Functions
of neighbours compose into a function of the same kind.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from latentspark.functions import checks
from latentspark.operators.scan import packed, prefixes, summarised, with_prefixes

#: (g, position, value held at the end), of highs ascending and of lows descending.
Records = list[tuple[float, float, float]]


def walk(g: np.ndarray, width: float, held: float) -> list[float]:
    out = []
    for v in g.tolist():
        if abs(v - held) > width:
            held = v
        out.append(held)
    return out


def _trimmed(highs: Records, lows: Records, width: float) -> tuple[Records, Records]:
    """Without records that nothing can meet first: once highs and lows lie two bands apart, everything has moved."""
    merged = sorted([(at, 0, g) for g, at, _ in highs] + [(at, 1, g) for g, at, _ in lows])
    top, low, last = -np.inf, np.inf, np.inf
    for at, side, g in merged:
        top, low = (g, low) if side == 0 else (top, g)
        if top - low > 2.0 * width * (1.0 + 1e-9) + 1e-300:
            last = at
            break
    return [r for r in highs if r[1] <= last], [r for r in lows if r[1] <= last]


def effect(g: np.ndarray, width: float) -> np.ndarray:
    """A chunk's function as an element: rows, number of highs, highs, lows."""
    v = g.tolist()
    highs, lows = [], []
    for i, x in enumerate(v):
        if not highs or x > highs[-1][0]:
            highs.append((x, float(i), x))
        if not lows or x < lows[-1][0]:
            lows.append((x, float(i), x))
    highs, lows = _trimmed(highs, lows, width)
    # Where each record leads: from the latest on, a walk ends where it meets one that is known.
    ends: dict[int, float] = {}
    for i in sorted({int(r[1]) for r in highs + lows}, reverse=True):
        held, moved = v[i], None
        for j in range(i + 1, len(v)):
            if abs(v[j] - held) > width:
                held, moved = v[j], j
                if moved in ends:
                    held = ends[moved]
                    break
        ends[i] = held
    led = lambda rs: [(x, at, ends[int(at)]) for x, at, _ in rs]
    return _element(len(v), led(highs), led(lows))


def _element(rows: float, highs: Records, lows: Records) -> np.ndarray:
    return np.array([float(rows), float(len(highs)), *(x for r in highs for x in r), *(x for r in lows for x in r)])


def _parts(e: np.ndarray) -> tuple[float, Records, Records]:
    records = [tuple(r) for r in np.asarray(e[2:]).reshape(-1, 3).tolist()]
    n = int(e[1])
    return float(e[0]), records[:n], records[n:]


def after(e: np.ndarray, width: float, held: float) -> float:
    """What a function makes of ``held``."""
    _, highs, lows = _parts(e)
    up = bisect_left(highs, True, key=lambda r: r[0] - held > width)
    down = bisect_left(lows, True, key=lambda r: held - r[0] > width)
    met = [rs[k] for rs, k in ((highs, up), (lows, down)) if k < len(rs)]
    return min(met, key=lambda r: r[1])[2] if met else held


def combined(first: np.ndarray, then: np.ndarray, width: float) -> np.ndarray:
    """The function of two neighbouring chunks."""
    n, highs, lows = _parts(first)
    m, more_highs, more_lows = _parts(then)
    top, low = (highs[-1][0] if highs else -np.inf), (lows[-1][0] if lows else np.inf)
    led = lambda rs: [(g, at, after(then, width, end)) for g, at, end in rs]
    highs = led(highs) + [(g, at + n, end) for g, at, end in more_highs if g > top]
    lows = led(lows) + [(g, at + n, end) for g, at, end in more_lows if g < low]
    return _element(n + m, *_trimmed(highs, lows, width))


def apply_band(series: DataFrame, width: float, start: float = 1.0, **sizes: int) -> DataFrame:
    """(series_id, t, x): ``x`` of (series_id, t, x) held while it is within ``width`` of what was held before, from ``start`` on.

    Equal to the walk row by row, exactly, wherever a series is cut. ``x`` must be
    finite; rows without series or ``t`` have no result; no rows give no rows."""
    checks.scalar(0.0 <= width < np.inf and np.isfinite(start), "needs a finite start and a width >= 0")
    chunks = packed(series, **sizes)

    def element(x: np.ndarray) -> np.ndarray:
        if not np.isfinite(x).all():
            raise ValueError("gate contains nulls, NaN or inf")
        return effect(x, width)

    found = prefixes(summarised(chunks, element), lambda a, b: combined(a, b, width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, t, x, before in pdf.itertuples(index=False, name=None):
                held = start if before is None else after(np.asarray(before), width, start)
                yield pd.DataFrame({"series_id": key, "t": t, "x": walk(np.asarray(x, dtype=float), width, held)})

    return with_prefixes(chunks, found).select("series_id", "t", "x", "before").mapInPandas(run, "series_id string, t long, x double")
