"""Best-fit packing of documents into fixed-length sequences.

Lengths are integers up to the sequence length, so what a packing needs to
know of the corpus is the histogram of lengths: at most 1024 counts at any
corpus size. Best-fit decreasing over the histogram yields bin patterns with
multiplicities; a swap-based local search then exchanges one for one, two for
one, one or two for two, or moves items between classes of underfull bins
wherever that raises the squared fill, until bins empty. Documents never pass through the driver: each
finds its bin from its length and its rank among equal lengths.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.llm.common import in_small_batches, sized_broadcast, sliced, written
from latentspark.llm.tokens import encoder

def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    ids_of = encoder(path).ids
    part = TaskContext.get().partitionId()
    seen = np.zeros(size + 1, dtype=np.int64)
    for b in sliced(batches):
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.append(ids_of(text), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % size + 1
            start = 0
            for piece, end in enumerate(range(first, len(ids) + 1, size)):
                rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, int(seen[end - start])))
                seen[end - start] += 1
                start = end
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids; ``part`` and ``nth`` number the pieces of one length within a task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows).mapInArrow(
        lambda it: _piece_batches(it, path, end_id, size),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long",
    )


def best_fit(histogram: dict[int, int], size: int) -> Counter:
    """Bins as {pattern: count}, a pattern being its lengths in descending
    order: each bin takes the longest item left, then again and again the
    longest that fits. Equal bins are made at once."""
    left = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(left)
    bins: Counter = Counter()
    while lengths:
        room, taken = size, []
        counts: Counter = Counter()
        at = len(lengths)
        while (at := bisect_right(lengths, room, 0, at)) > 0:
            k = lengths[at - 1]
            n = min(room // k, left[k])
            counts[k] = n
            taken += [k] * n
            room -= n * k
            at -= 1
        times = min(left[k] // n for k, n in counts.items())
        bins[tuple(taken)] += times
        for k, n in counts.items():
            left[k] -= n * times
            if not left[k]:
                lengths.remove(k)
    return bins


def _subsets(pattern: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """(sum, items) of the distinct choices of one or two items, by sum; of equal sums the one with fewer items."""
    found: dict[int, tuple[int, ...]] = {x: (x,) for x in pattern}
    for i, x in enumerate(pattern):
        for y in pattern[i + 1 :]:
            found.setdefault(x + y, (x, y))
    return sorted(found.items())


def _better(a: tuple[int, ...], b: tuple[int, ...], size: int, subsets: Callable = _subsets) -> tuple[tuple, tuple] | None:
    """(items to leave a, items to leave b) that fill a most, of moves and
    exchanges of one or two for one or two; None if none raises a's fill. a is the fuller."""
    room = size - sum(a)
    given = subsets(b)
    sums = [g[0] for g in given]
    best, found = 0, None
    for lost, out in [(0, ()), *subsets(a)]:
        k = bisect_right(sums, room + lost) - 1
        if k >= 0 and sums[k] - lost > best:
            best, found = sums[k] - lost, (out, given[k][1])
            if best == room:
                break
    return found


class _Open:
    """The classes of underfull bins, and which pairs of them have an improving exchange.

    A pair's best exchange depends on the two patterns alone, so it is looked
    at once, when the later of them appears: against all others together, as arrays."""

    def __init__(self, size: int):
        self.size, self.subsets = size, cache(_subsets)
        self.patterns: list[tuple[int, ...]] = []  # by fill
        self.fills: list[int] = []
        self.sums: list[np.ndarray] = []  # what each can give
        self.caps: list[np.ndarray] = []  # what each can take for each it gives back, over that
        self.takers: dict[tuple, list[tuple[int, tuple]]] = {}  # heaps by fill
        self.own: dict[tuple, bool] = {}  # whether one of its bins gains from another

    def add(self, pattern: tuple[int, ...]) -> None:
        fill = sum(pattern)
        sums = np.array([x for x, _ in self.subsets(pattern)], dtype=np.int64)
        lost = np.concatenate([[0], sums])
        caps = np.stack([self.size - fill + lost, lost])
        at = bisect_right(self.fills, fill)
        self.takers[pattern] = self._takers(sums, at)
        got = np.append(0, sums)[np.searchsorted(sums, caps[0], "right")]
        self.own[pattern] = bool((got > caps[1]).any())
        for k in self._givers(caps, at):
            heapq.heappush(self.takers[self.patterns[k]], (fill, pattern))
        for items, x in ((self.patterns, pattern), (self.fills, fill), (self.sums, sums), (self.caps, caps)):
            items.insert(at, x)

    def drop(self, pattern: tuple[int, ...]) -> None:
        at = self.patterns.index(pattern, bisect_left(self.fills, sum(pattern)))
        for items in (self.patterns, self.fills, self.sums, self.caps):
            del items[at]
        del self.takers[pattern], self.own[pattern]

    def _takers(self, sums: np.ndarray, at: int) -> list[tuple[int, tuple]]:
        """Which of the classes from ``at`` on gain from one that can give ``sums``, with their fills in order."""
        if at == len(self.caps):
            return []
        room, lost = np.concatenate(self.caps[at:], axis=1)
        got = np.append(0, sums)[np.searchsorted(sums, room, "right")]
        ends = np.cumsum([c.shape[1] for c in self.caps[at:]])
        hits = np.unique(np.searchsorted(ends, np.flatnonzero(got > lost), "right"))
        return sorted((self.fills[at + k], self.patterns[at + k]) for k in hits.tolist())

    def _givers(self, caps: np.ndarray, at: int) -> list[int]:
        """Which of the classes before ``at`` have something that one with ``caps`` gains from."""
        if not at:
            return []
        step = 4 * self.size
        base = np.repeat(np.arange(at) * step, [len(x) for x in self.sums[:at]])
        keys = np.append(base + np.concatenate(self.sums[:at]), at * step)
        room = (np.arange(at) * step)[:, None] + caps[0]
        k = np.searchsorted(keys, room, "right") - 1
        got = np.where(k >= 0, keys[k] - (np.arange(at) * step)[:, None], -1)
        return np.flatnonzero((got > caps[1]).any(axis=1)).tolist()

    def next_pair(self, bins: Counter) -> tuple[tuple, tuple] | None:
        """The emptiest class that can give, and the emptiest that gains from it: itself, where it has two bins."""
        for b in self.patterns:
            if self.own[b] and bins[b] > 1:
                return b, b
            takers = self.takers[b]
            while takers:
                if takers[0][1] in self.takers:
                    return takers[0][1], b
                heapq.heappop(takers)  # there is none any more
        return None


def improve(bins: Counter, size: int) -> Counter:
    """Local search over classes of equal underfull bins, until no exchange between two bins helps.

    The emptiest class gives, and of the others the emptiest that gains takes,
    which leaves small rooms for small items; an exchange raises the sum of
    squared fills because the taker is the fuller, or both are alike. It is made in as many pairs
    of bins as both classes have, or as one class has in itself. Ends when no two underfull
    bins can be improved, or no sequence fewer is possible; that need not be the fewest sequences, which
    exchanges of more bins at once might reach. The number of
    classes depends on ``size`` and not on the number of documents."""
    bins = Counter(bins)
    fewest = -(-sum(sum(p) * n for p, n in bins.items()) // size)
    total = sum(bins.values())
    open_ = _Open(size)
    for p in sorted(bins):
        if sum(p) < size:
            open_.add(p)

    def change(pattern: tuple[int, ...], by: int) -> None:
        if not pattern:
            return
        before = bins[pattern]
        bins[pattern] = before + by
        if sum(pattern) < size:
            if not before:
                open_.add(pattern)
            elif not bins[pattern]:
                open_.drop(pattern)
        if not bins[pattern]:
            del bins[pattern]

    swap = lambda p, out, got: tuple(sorted((Counter(p) - Counter(out) + Counter(got)).elements(), reverse=True))
    while total > fewest and (pair := open_.next_pair(bins)):
        a, b = pair
        move = _better(a, b, size, open_.subsets)
        n = bins[a] // 2 if a == b else min(bins[a], bins[b])
        new_a, new_b = swap(a, *move), swap(b, *move[::-1])
        total -= n * (not new_b)
        for p, by in ((a, -n), (b, -n), (new_a, n), (new_b, n)):
            change(p, by)
    return bins


def layout(bins: Counter) -> np.ndarray:
    """Rows (length, first rank, items per bin, first bin, offset of the first item), sorted by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, count in sorted(bins.items(), reverse=True):
        offset = 0
        for k, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((k, used[k], n, base, offset))
            used[k] += n * count
            offset += n * k
        base += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place_batches(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = 1 << 46
    keys = plan[:, 0] * step + plan[:, 1]
    for b in batches:
        length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
        _, first, each, base, offset = plan[np.searchsorted(keys, length * step + rank, side="right") - 1].T
        sequence, nth = np.divmod(rank - first, np.maximum(each, 1))
        kept = [b.column(k) for k in range(b.num_columns) if b.schema.names[k] != "rank"]
        names = [x for x in b.schema.names if x != "rank"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(base + sequence), pa.array(offset + nth * length)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Only documents of more than
    ``size`` ids are cut, however many pieces they give; all pieces but the first have ``size`` ids. Pieces of
    one length are interchangeable: they are numbered by task and order within it. Repeated
    rows are packed as often as they occur, null doc_ids stay null, other
    columns are ignored, whatever their names, an empty table gives an empty result."""
    cut = written(pieces(docs, path, end_id, size, id_col, text_col), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = written(counts.select("part", "length", before.alias("before")), "ranks")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    plan = layout(improve(best_fit(histogram, size), size))
    ranked = cut.join(sized_broadcast(starts), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(
        lambda it: _place_batches(it, plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
