"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are 64-bit majorities over the XXH64 hashes of word shingles.
Equal fingerprints collapse to one class first. Classes are then dealt to
buckets such that any two within the radius meet: 64 bits are cut into
``radius + 2`` blocks, and two fingerprints that differ in at most ``radius``
bits agree on two whole blocks at least, so every pair of blocks is one
bucket key (15 keys of about 21 bits for radius 4). Inside a bucket, distances
of many pairs are counted together from vertically stored bit planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import connected_components, fresh, in_small_batches, sized_broadcast, sliced, written

#: A bucket with more classes is compared as pairs of chunks of this size, each in its own group.
CHUNK = 2048
_LANES = 1 << 16


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of one UTF-8 text, repeats included: A-Z
    lower-cased, words cut at ASCII white space, ``width`` words to a shingle.
    Fewer words make one shingle; no words (or null) none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 without any."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text: the majority of its shingles' hashes."""
    return majority(shingle_hashes(text, width, seed))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; fp holds the 64 bits, signed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return in_small_batches(rows).mapInArrow(lambda it: _fingerprint_batches(it, width, seed), "doc_id long, fp long")


def distances(planes: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """In how many rows the columns i[k] and j[k] of ``planes`` differ; ``radius`` + 1 where in more than ``radius``.

    ``planes`` is bits x items, 0 or 1. Pairs are lanes of packed words; each
    step adds two planes' differences into bit-sliced counters with a
    carry-save adder. A block of lanes is left as soon as all exceed the radius.
    """
    out = np.full(len(i), radius + 1, dtype=np.int64)
    for at in range(0, len(i), _LANES):
        a, b = i[at : at + _LANES], j[at : at + _LANES]
        counter = [np.zeros((len(a) + 7) // 8, np.uint8) for _ in range((radius + 1).bit_length())]
        over = np.zeros_like(counter[0])
        if len(a) % 8:
            over[-1] = 0xFF >> len(a) % 8  # lanes beyond the last pair
        for bit in range(0, len(planes), 2):
            d = np.packbits(planes[bit, a] ^ planes[bit, b])
            e = np.packbits(planes[bit + 1, a] ^ planes[bit + 1, b]) if bit + 1 < len(planes) else np.zeros_like(d)
            half = counter[0] ^ d
            carry = (counter[0] & d) | (half & e)
            counter[0] = half ^ e
            for k in range(1, len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if bit % 8 == 6 and (_exceeds(counter, over, radius) == 255).all():
                break
        near = np.flatnonzero(np.unpackbits(~_exceeds(counter, over, radius), count=len(a)))
        if len(near):
            byte, bit = near >> 3, 7 - (near & 7)
            out[at + near] = sum((c[byte] >> bit & 1).astype(np.int64) << k for k, c in enumerate(counter))
    return out


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is over ``radius``."""
    greater, equal = over.copy(), ~over
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            greater |= equal & counter[k]
            equal &= ~counter[k]
    return greater


def _spanning_links(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (item, least linked item of its tree) of the graph whose
    edges join items of one bucket within the radius. Rows are sorted by bucket."""
    planes = np.ascontiguousarray(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).T)
    root = np.arange(len(fps))
    i = np.arange(len(fps))
    for shift in range(1, len(fps)):
        i = i[: np.searchsorted(i, len(fps) - shift)]
        i = i[bucket[i] == bucket[i + shift]]
        if not len(i):
            break
        hit = i[distances(planes, i, i + shift, radius) <= radius]
        while True:  # pointers lead to roots
            further = root[root]
            if (further == root).all():
                break
            root = further
        hit = hit[root[hit] != root[hit + shift]]
        for x, y in zip(hit.tolist(), (hit + shift).tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
    while (root[root] != root).any():
        root = root[root]
    item = np.flatnonzero(root != np.arange(len(fps)))
    return item, root[item]


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) sorted by bucket in; spanning links out. The last bucket of a batch waits for the next."""
    kept = (np.empty(0, np.int64), np.empty(0, np.uint64))

    def links(bucket, fps):
        item, root = _spanning_links(bucket, fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(fps[item].view(np.int64)), pa.array(fps[root].view(np.int64))], ["a", "b"])

    for batch in batches:
        bucket = np.concatenate([kept[0], batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([kept[1], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
        if not len(bucket):
            continue
        cut = np.searchsorted(bucket, bucket[-1])
        if cut:
            yield links(bucket[:cut], fps[:cut])
        kept = (bucket[cut:], fps[cut:])
    if len(kept[0]):
        yield links(*kept)


def block_layout(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of the ``radius + 2`` blocks that the fingerprint is cut into."""
    n = radius + 2
    edges = [bits * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def links_within(classes: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of ``classes`` that connect
    exactly what all pairs within ``radius`` bits connect.

    A bucket of more than ``chunk`` classes is compared chunk against chunk,
    every two chunks in a group of their own, so a hot bucket is spread over
    tasks and none is cut short."""
    part = lambda lo, width: F.shiftrightunsigned("fp", lo).bitwiseAND((1 << width) - 1)
    keys = [
        F.struct(F.lit(k).alias("band"), F.shiftleft(part(*x), y[1]).bitwiseOR(part(*y)).alias("key"))
        for k, (x, y) in enumerate(combinations(block_layout(radius), 2))
    ]
    dealt = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.xxhash64("k.band", "k.key").alias("bucket"), "fp")
    return spread(dealt, ["fp"], chunk).mapInArrow(lambda it: _link_batches(it, radius), "a long, b long").distinct()


def hot_buckets(dealt: DataFrame, items: list[str], chunk: int = CHUNK) -> DataFrame:
    """(bucket, n) of the buckets with more than about ``chunk`` items, by one item in 16 where chunks are large."""
    part = 16 if chunk >= 1024 else 1
    some = dealt.where(F.pmod(F.xxhash64(*items, F.lit(5)), F.lit(part)) == 0)
    return written(some.groupBy("bucket").agg((F.count("*") * part).alias("n")).where(F.col("n") > chunk), "hot-buckets")


def spread(dealt: DataFrame, items: list[str], chunk: int = CHUNK) -> DataFrame:
    """Rows (bucket, items...) partitioned and sorted by bucket; a bucket of more
    than about ``chunk`` rows becomes a bucket for every two of its chunks.

    Sizes decide only how rows are dealt, never which, so they are estimated
    from one item in 16 where chunks are large; all rows are moved once."""
    hot = hot_buckets(dealt, items, chunk)
    if not hot.isEmpty():
        rows = dealt.join(sized_broadcast(hot), "bucket", "left")
        pieces = F.ceil(F.col("n") / chunk).cast("int")
        mine = F.pmod(F.xxhash64(*items, F.lit(7)), pieces).cast("int")
        split = (
            rows.where("n is not null")
            .select("bucket", *items, mine.alias("mine"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("other"))
            .select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), *items)
        )
        dealt = rows.where("n is null").select("bucket", *items).unionByName(split)
    return dealt.repartition("bucket").sortWithinPartitions("bucket")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hex
    digits), component_id (least doc_id reachable over links of at most
    ``radius`` differing bits, itself included).

    Null and empty texts have fingerprint zero and link like any other; very long texts are read whole.
    Repeated rows come out as often as they went in. Null doc_ids are never a
    component's id unless no other is reachable (then it is null). Further
    columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links_within(classes.select("fp"), radius))
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    heads = classes.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", F.col("fp").alias("root"), "least")
    members = linked.unionByName(heads)
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    changed = written(members.join(least, "root").select("fp", "component_id"), "members")
    return (
        marked.join(classes.join(changed, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


# ---- near copies by shingle similarity

#: Documents whose shingles are counted to order all shingles by rarity, and the most of these counts that are kept. They set the order, never which pairs are found.
COUNTED, RANKED = 16_000, 200_000
#: Prefixes are longer by this share of a set than one common shingle needs, so that alike sets share that many.
EXTRA = 1 / 16
#: Nodes (16 bytes each) up to which a list of them is broadcast to texts or sets.
NAMED_BROADCAST = 400_000
#: Shingles and pairs of a cell from which it is dealt to several.
CELL_SHINGLES, CELL_PAIRS = 1 << 20, 1 << 18
_PAIRS = 1 << 18
#: Buckets with the most items in which unjoined sets meet: as many (bits of a positive long), of over so many items. A pair that shares several of them is compared in the first only.
LARGE_BUCKETS, LARGE = 63, CHUNK // 16
#: Words of 64 bits of a set's parity map. A bit holds whether an odd number of shingles fall on it, so two maps differ in no more bits than their sets in shingles.
PARITY_WORDS = 32


def least_shared(n: int, similarity: float) -> int:
    """How many shingles the prefix of a set of ``n`` shares at least with that of any set of that similarity."""
    return int(EXTRA * np.ceil(similarity * n - 1e-9)) + 1


def prefix_length(n: int, similarity: float) -> int:
    """Length of a set's prefix, in any order common to all sets. Alike sets a
    and b have ``similarity * max`` shingles in common; the first of these lie in
    both prefixes, ``EXTRA`` of the smaller size and one at least."""
    return min(n, n - int(np.ceil(similarity * n - 1e-9)) + int(EXTRA * n) + 1)


class _WordHashes(dict):
    """XXH64 of words, remembered up to a number of short words."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: bytes | None, width: int, words_of: _WordHashes) -> np.ndarray:
    """Distinct 64-bit names of a text's shingles, in order; the same shingles as :func:`shingle_hashes`, each named by its words' hashes."""
    words = text.lower().split() if text else []
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), words_of.seed)] if words else [], dtype=np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ h[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def parity_map(h: np.ndarray) -> np.ndarray:
    """The parity map of a set of shingle hashes."""
    n = 64 * PARITY_WORDS
    odd = np.bincount((h % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in sets], dtype=np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray], kept: np.ndarray | None = None) -> pa.Array:
    """Arrays of 64 bits as a list column; null where not ``kept``."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    mask = None if kept is None else pa.array(~kept)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)), mask=mask)


def _first_seen(nodes: np.ndarray, seen: set) -> np.ndarray:
    """Which nodes this task meets for the first time, as far as it remembers; a repeat costs work and changes nothing."""
    out = np.ones(len(nodes), bool)
    for k, x in enumerate(nodes.tolist()):
        if x in seen:
            out[k] = False
        elif len(seen) < 1 << 20:
            seen.add(x)
    return out


def _shingle_batches(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    words_of = _WordHashes(seed)
    for b in sliced(batches):
        got = [shingle_set(t, width, words_of) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *got]).view(np.int64))], ["h"])


def _set_batches(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, shingles, parity): a name for each text's set of shingles, their distinct hashes in order, and its parity map."""
    seen: set[int] = set()
    words_of = _WordHashes(seed)
    for b in sliced(batches):
        got = [shingle_set(t, width, words_of) for t in b.column(1).to_pylist()]
        node = _nodes(got)
        new = np.flatnonzero(_first_seen(node, seen))
        maps = [parity_map(got[k]).view(np.uint64) for k in new]
        yield pa.RecordBatch.from_arrays([pa.array(node[new]), _lists([got[k] for k in new]), _lists(maps)], ["node", "shingles", "parity"])


def _prefix_batches(batches: Iterator[pa.RecordBatch], width: int, seed: int, similarity: float, ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, fp, size, prefix): the set's name, SimHash, size, and rarest shingles, these once in a task."""
    known, counts = ranks
    seen: set[int] = set()
    words_of = _WordHashes(seed)
    for b in sliced(batches):
        got = [shingle_set(t, width, words_of) for t in b.column(1).to_pylist()]
        node = _nodes(got)
        new = _first_seen(node, seen)
        prefixes = []
        for h, wanted in zip(got, new.tolist(), strict=True):
            if wanted and len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
            prefixes.append(h[: prefix_length(len(h), similarity) if wanted else 0])
        fp = pa.array(np.array([majority(h) for h in got], dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), fp, pa.array([len(h) for h in got], pa.int32()), _lists(prefixes, new)], ["doc_id", "node", "fp", "size", "prefix"])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, cut between its values: the last value of a batch waits for the next."""
    kept = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero(cols[0] != cols[0][-1])
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield [c[:cut] for c in cols]
        kept = [c[cut:] for c in cols]
    if kept is not None and len(kept[0]):
        yield kept


def _bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal keys, and each row's run."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _shared_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(node, size, bucket, n) of the rows whose bucket has another node of a size that can be alike; n counts its nodes."""
    for bucket, node, size in _by_key(batches):
        order = np.lexsort((node, size, bucket))
        bucket, node, size = bucket[order], node[order], size[order]
        start, _ = _bounds(bucket, node)  # of copies one
        bucket, node, size = bucket[start], node[start], size[start]
        start, run = _bounds(bucket)
        near = (bucket[1:] == bucket[:-1]) & (size[:-1] + 1e-6 >= similarity * size[1:])
        on = np.append(near, False) | np.append(False, near)
        n = np.diff([*start, len(run)])[run]
        yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (node, size, bucket, n)], ["node", "size", "bucket", "n"])


def _active_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, bucket, size) sorted so. Of each node that shares enough
    buckets, its rarest, as many as leave less than enough: (bucket, node, size, place)."""
    for node, n, bucket, size in _by_key(batches):
        start, _ = _bounds(node, n, bucket)
        node, bucket, size = node[start], bucket[start], size[start]
        start, run = _bounds(node)
        count = np.diff([*start, len(run)])
        enough = np.array([least_shared(int(x), similarity) for x in size[start]])
        at = np.arange(len(run)) - start[run]
        on = at <= (count - enough)[run]
        place = count[run] << 32 | at
        yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (bucket, node, size, place)], ["bucket", "node", "size", "place"])


def _may_link(size: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets that share a bucket at these places can be alike: their
    sizes allow it, and so do the shared buckets from there on. ``place`` holds
    shared buckets << 32 | position."""
    low = (1 << 32) - 1
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    rest = np.minimum((place[a] >> 32) - (place[a] & low), (place[b] >> 32) - (place[b] & low))
    before = np.minimum(place[a] & low, place[b] & low)
    return (small + 1e-6 >= similarity * large) & (rest + before >= np.floor(EXTRA * small) + 1)


def _pair_batch(cell: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(a, b, cell) of each pair once, with its least cell."""
    x, y, cell = np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), cell[a]
    on = x != y
    x, y, cell = x[on], y[on], cell[on]
    order = np.lexsort((cell, y, x))
    x, y, cell = x[order], y[order], cell[order]
    first = _bounds(x, y)[0] if len(x) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(v[first]) for v in (x, y, cell)], ["a", "b", "cell"])


def _hub_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Two links an item: to the one nearest to the majority of its bucket's
    fingerprints, which is the text that the others are copies of, and to the
    next in size. They join most of a large group before others are compared.
    Distances are bit-sliced: each item against its bucket's majority."""
    for bucket, node, fp, size, place in _by_key(batches):
        order = np.lexsort((node, size, bucket))
        bucket, node, fp, size, place = bucket[order], node[order], fp[order], size[order], place[order]
        start, run = _bounds(bucket)
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1)
        members = np.diff([*start, len(run)])
        middle = (2 * np.add.reduceat(bits, start, axis=0, dtype=np.int64) > members[:, None]).astype(np.uint8)
        item = np.arange(len(run))
        near = np.lexsort((node, distances(np.ascontiguousarray(np.concatenate([bits, middle]).T), item, len(item) + run, 64), run))
        follows = item[1:][run[1:] == run[:-1]]
        a, b = np.concatenate([item, follows]), np.concatenate([near[start][run], follows - 1])
        on = _may_link(size, place, a, b, similarity)
        yield _pair_batch(bucket, node, a[on], b[on])


def _may_be_alike(size: np.ndarray, parity: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets can be alike by their parity maps: alike ones differ in at most
    ``(1 - s) / (1 + s)`` of their sizes' sum, and their maps in no more bits."""
    differ = np.bitwise_count((parity[a] ^ parity[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return differ <= (1.0 - similarity) / (1.0 + similarity) * (size[a] + size[b]) + 1e-6


def _rest_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Every pair of a bucket that can be alike, by places, sizes and parity maps, isn't joined by verified links yet and
    shares none of the large buckets ``before`` this one; ``large`` are those that an item is in, as bits."""
    for bucket, node, root, size, place, large, before, *words in _by_key(batches):
        order = np.lexsort((root, bucket))
        bucket, node, root, size, place, large = bucket[order], node[order], root[order], size[order], place[order], large[order]
        earlier = large & before[order]
        parity = np.stack(words, axis=1)[order]
        start, run = _bounds(bucket)
        same, group = _bounds(bucket, root)
        after = np.append(same[1:], len(run))[group]
        n = np.append(start[1:], len(run))[run] - after
        total = np.cumsum(n)
        for at in range(0, int(total[-1]), _PAIRS):
            end = min(at + _PAIRS, int(total[-1]))
            first, last = np.searchsorted(total, (at, end - 1), side="right")
            mine = np.arange(first, last + 1)
            times = np.diff(np.minimum(total[mine], end), prepend=at)
            a = np.repeat(mine, times)
            b = np.arange(at, end) + np.repeat((after - total + n)[mine], times)
            on = np.repeat(earlier[mine], times) & large[b] == 0
            a, b = a[on], b[on]
            on = _may_link(size, place, a, b, similarity)
            a, b = a[on], b[on]
            on = _may_be_alike(size, parity, a, b, similarity)
            yield _pair_batch(bucket, node, a[on], b[on])


def _alike(pairs: pa.Table, sets: pa.Table, similarity: float) -> pa.Table:
    """Links of one cell: its pairs in turn, each either joined by links found before or compared on whole sets."""
    lists = sets.column("shingles").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    at = {x: k for k, x in enumerate(sets.column("node").to_pylist())}
    shingles = lambda x: values[ends[at[x]] : ends[at[x] + 1]]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    links = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        x, y = find(a), find(b)
        if x == y:
            continue
        p, q = shingles(a), shingles(b)
        both = np.sort(np.concatenate([p, q]))
        shared = int((both[1:] == both[:-1]).sum())
        if shared + 1e-9 >= similarity * (len(p) + len(q) - shared):
            root[max(x, y)] = min(x, y)
            links.append((a, b))
    got = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.table([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def _verified(pairs: DataFrame, active: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join what the ``pairs`` (a, b, cell) whose whole shingle sets are alike join.

    A pair is compared in one cell, a bucket that both are in, so that each
    set is moved once a cell and not once a pair; a cell of many shingles or
    pairs becomes a cell for every two of its parts."""
    pairs = written(pairs.groupBy("a", "b").agg(F.min("cell").alias("cell")), "candidates")
    in_cell = lambda rows: rows.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = in_cell(pairs).join(sized_broadcast(active.select("node", "size"), NAMED_BROADCAST), "node")
    weight = sizes.groupBy("cell").agg(F.sum("size").alias("n")).join(pairs.groupBy("cell").agg(F.count("*").alias("k")), "cell")
    weight = written(weight.withColumn("load", F.greatest(F.col("n") / CELL_SHINGLES, F.sqrt(F.col("k") / CELL_PAIRS))), "cells")
    heavy = weight.where("load > 1").select("cell", F.ceil(2 * F.col("load")).alias("parts"))
    light = int(4 * (weight.where("load <= 1").agg(F.sum("load")).first()[0] or 0)) + 1
    # Light cells are dealt to groups of several; a group compares each pair once, whatever the cell.
    cell = F.pmod(F.xxhash64("cell"), F.lit(light))
    if heavy.isEmpty():
        pairs = pairs.withColumn("cell", cell)
    else:
        part = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.col("parts"))
        dealt = F.xxhash64("cell", F.least(part("a"), part("b")), F.greatest(part("a"), part("b")))
        pairs = pairs.join(sized_broadcast(heavy), "cell", "left").select("a", "b", F.when(F.col("parts").isNull(), cell).otherwise(dealt).alias("cell"))
    wanted = written(in_cell(pairs), "cells")
    moved = sets.join(sized_broadcast(wanted, NAMED_BROADCAST), "node").select("cell", "node", "shingles")
    return written(pairs.groupBy("cell").cogroup(moved.groupBy("cell")).applyInArrow(lambda p, s: _alike(p, s, similarity), "a long, b long"), "verified")


def _with_large(items: DataFrame) -> DataFrame:
    """``items`` (bucket, node, ...) with ``large``, the large buckets that its node is in, as bits, and ``before``, those that come before its bucket: all, if it isn't one."""
    spark = items.sparkSession
    most = items.groupBy("bucket").count().where(F.col("count") > LARGE).orderBy(F.col("count").desc(), "bucket").limit(LARGE_BUCKETS).collect()
    if not most:
        return items.withColumns({"large": F.lit(0).cast("long"), "before": F.lit(-1).cast("long")})
    bits = F.broadcast(spark.createDataFrame([(r["bucket"], 1 << k) for k, r in enumerate(most)], "bucket long, bit long"))
    large = written(items.join(bits, "bucket").groupBy("node").agg(F.bit_or("bit").alias("large")), "large")
    found = items.join(bits, "bucket", "left").join(sized_broadcast(large, NAMED_BROADCAST), "node", "left")
    return found.withColumns({"large": F.coalesce("large", F.lit(0)), "before": F.coalesce(F.col("bit") - 1, F.lit(-1))}).drop("bit")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, the least doc_id
    reachable over links between texts whose sets of ``width``-word shingles
    have a Jaccard similarity of at least ``similarity``.

    Texts with equal sets are one class; texts without words are one, too. Two
    sets that are alike share several of the first shingles of each in any
    common order (prefix filtering), so classes meet in a bucket for each of
    their rarest shingles, whatever the number of documents; a class that
    shares too few buckets links with nothing, and of the others the least
    frequent buckets are enough. Every link is verified on whole shingle sets:
    first two an item and bucket, chosen by SimHash distance, then every pair
    that these have not joined and that parity maps of the whole sets, which bound the
    shingles not shared from below, do not rule out. Rows whose id is null have no component of
    their own but that of their class, null if no row of it has an id. Null
    and very long texts are like any other; repeated rows come out as often as
    they went in; an empty table gives an empty result."""
    rows = in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")))
    parts = max(1, rows.count() // COUNTED)
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)) == 0).mapInArrow(lambda it: _shingle_batches(it, width, seed), "h long")
    counted = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc()).limit(RANKED).toPandas()
    known, n = counted["h"].to_numpy(np.int64).view(np.uint64), counted["n"].to_numpy(np.int64)
    ranks = (known[np.argsort(known)], n[np.argsort(known)])
    marked = written(rows.mapInArrow(lambda it: _prefix_batches(it, width, seed, similarity, ranks), "doc_id long, node long, fp long, size int, prefix array<long>"), "prefixes")
    dealt = marked.select("node", "size", F.explode("prefix").alias("bucket")).select("bucket", "node", "size")
    hot = sized_broadcast(hot_buckets(dealt, ["node"]))
    rare = dealt.join(hot, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    shared = rare.mapInArrow(lambda it: _shared_batches(it, similarity), "node long, size long, bucket long, n long")
    shared = shared.unionByName(dealt.join(hot, "bucket").select("node", F.col("size").cast("long").alias("size"), "bucket", "n"))
    by_node = shared.select("node", "n", "bucket", "size").repartition("node").sortWithinPartitions("node", "n", "bucket")
    placed = written(by_node.mapInArrow(lambda it: _active_batches(it, similarity), "bucket long, node long, size long, place long"), "shared")
    nodes = sized_broadcast(written(placed.select("node").distinct(), "nodes"), NAMED_BROADCAST)
    classes = marked.groupBy("node").agg(F.min("doc_id").alias("least"))
    active = written(marked.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("size").alias("size")), "active")
    named = active.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    texts = rows.join(sized_broadcast(named, NAMED_BROADCAST), "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    sets = written(texts.select("doc_id", "text").mapInArrow(lambda it: _set_batches(it, width, seed), "node long, shingles array<long>, parity array<long>").join(nodes, "node", "left_semi"), "shingles")
    items = placed.join(sized_broadcast(active.select("node", "fp"), NAMED_BROADCAST), "node").select("bucket", "node", "fp", "size", "place")
    pair = "a long, b long, cell long"
    hubs = spread(items, ["node", "fp", "size", "place"]).mapInArrow(lambda it: _hub_batches(it, similarity), pair)
    first = _verified(hubs, active, sets, similarity)
    roots = written(connected_components(first), "roots")
    rooted = written(placed.join(sized_broadcast(roots, NAMED_BROADCAST), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "size", "place"), "rooted")
    # Where all are joined nothing is left to compare; elsewhere parity maps go along, so that hardly a pair that isn't alike is written.
    unjoined = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
    open_items = rooted.join(sized_broadcast(written(unjoined, "unjoined"), NAMED_BROADCAST), "bucket", "left_semi")
    words = [f"w{k}" for k in range(PARITY_WORDS)]
    maps = sets.dropDuplicates(["node"]).select("node", *(F.col("parity")[k].alias(w) for k, w in enumerate(words)))
    names = ["node", "root", "size", "place", "large", "before", *words]
    items = written(_with_large(open_items).join(maps, "node").select("bucket", *names), "unjoined-items")
    rest = spread(items, names).mapInArrow(lambda it: _rest_batches(it, similarity), pair)
    links = first.unionByName(_verified(rest, active, sets, similarity))
    known = classes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(known.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group of :func:`near_copies`.

    Of rows with equal ids one stays. Rows without an id always stay. All
    columns are kept as they are, whatever their names; the other rows of a
    group go. Null and empty texts are one group; an empty table stays empty."""
    found = near_copies(docs, width, similarity, id_col=id_col, text_col=text_col)
    key, gone, n = fresh(docs, "id", "gone", "n")
    odd = written(
        found.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.max(F.col("doc_id") != F.col("component_id")).alias(gone), F.count("*").alias(n))
        .where(f"{gone} or {n} > 1"),
        "gone",
    )
    rows = docs.join(odd, F.col(id_col).cast("long") == F.col(key), "left").where(f"{gone} is null or not {gone}")
    names = [f"`{c}`" for c in docs.columns]
    if odd.where(f"not {gone}").isEmpty():
        return rows.select(*names)
    repeated = rows.where(f"{n} > 1").dropDuplicates([key])
    return rows.where(f"{n} is null").unionByName(repeated).select(*names)
