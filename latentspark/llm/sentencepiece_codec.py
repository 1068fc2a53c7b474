"""SentencePiece BPE encoding and decoding by suffix-array matching.

The text of a batch, its repeated words once and without those that the worker
remembers, is put end to end and indexed by a suffix array; every piece of the vocabulary is looked up in it by binary
search, which yields all its occurrences at once. Occurrences are edges of a
lattice. Sorted by where they end, they are relaxed position by position, all
words in lockstep: the edge that may follow the token before it is the last
token of that prefix's encoding, and there is exactly one. Two tokens may
follow one another if no merge would have crossed the border between them;
that is read off the merges that made them, latest first.

Ids equal those of the sentencepiece library for its BPE models.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Bytes of words and their ids that a worker's cache holds, and characters of a word that it keeps; other words are matched in each batch anew.
CACHE_BYTES, CACHE_CHARS = 96 << 20, 48
#: A longer word is relaxed in stretches of so many characters, all at once, which overlap.
STRETCH, OVERLAP = 1024, 256
#: Characters that are indexed at a time.
INDEX_CHARS = 1_000_000
_NONE = np.iinfo(np.int64).max


class _PairTable:
    """(left, right) -> rank of the merged piece, as an open-addressing table that answers arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(len(pairs), 1)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int64)
        for (a, b), rank in pairs.items():
            at = int(self._slot(np.array([a << 32 | b]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.ranks[at] = a << 32 | b, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Codec:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        normal = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = m.unk_id()
        self.byte_fallback = self.byte_ids[0] != self.unknown
        order = sorted((i for p, i in normal.items() if len(p) > 1), key=lambda i: (-m.get_score(i), i))
        #: Rank of the merge that makes a piece; -1 for single characters.
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        pairs: dict[tuple[int, int], int] = {}
        for i in order:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = int(self.rank[i])
        merged = {r: i for i, r in enumerate(self.rank.tolist()) if r >= 0}
        self.left, self.right = np.arange(n), np.arange(n)
        usable = [i for p, i in normal.items() if len(p) == 1]
        for i in order:
            symbols, last = [normal.get(c, -1) for c in self.pieces[i]], None
            while len(symbols) > 1:
                best = min(((pairs.get(x, _NONE), k) for k, x in enumerate(zip(symbols, symbols[1:], strict=False))), default=(_NONE, 0))
                if best[0] == _NONE:
                    break
                k = best[1]
                last = symbols[k], symbols[k + 1]
                symbols[k : k + 2] = [merged[best[0]]]
            if symbols == [i]:
                self.left[i], self.right[i] = last
                usable.append(i)
        self.pairs, self.merges, self.made = _PairTable(pairs), pairs, merged
        self.char_ids = {p: i for p, i in normal.items() if len(p) == 1}
        self.chars = {p for p in normal if len(p) == 1}
        self.usable = np.array(sorted(usable))
        self.length = np.array([len(p) for p in self.pieces])
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        #: No piece goes on into the next word, so words are encoded one by one.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        beside = {c for p in normal for x, y in zip(p, p[1:], strict=False) if x.isalpha() != y.isalpha() for c in (x, y)}
        marks = re.escape("".join(c for c in map(chr, [10, *range(33, 127)]) if not c.isalnum() and c not in beside))
        #: Between a letter and a mark that no piece has next to a letter.
        self.borders = re.compile(f"(?<=[^\\W\\d_])(?=[{marks}])|(?<=[{marks}])(?=[^\\W\\d_])") if marks else re.compile("(?!)")
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self.shown = [" " if s and not m.is_unknown(i) else p.replace(SPACE, " ") for i, (p, s) in enumerate(zip(self.pieces, special, strict=True))]
        self.first_byte = min(self.byte_ids)

    # -- matching

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece. NUL stands between words."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        alphabet, codes = np.unique(points, return_inverse=True)
        # NUL is the least code and pads; a key holds eight codes of 8 bits, or four of 16.
        bits = 8 if len(alphabet) <= 255 else 16
        per = 64 // bits
        width = -(-self.longest // per)
        padded = np.concatenate([codes, np.zeros(width * per, dtype=codes.dtype)]).astype(np.uint64)
        keys = []
        for w in range(width):
            key = np.zeros(len(codes), dtype=np.uint64)
            for k in range(per):
                key = key << np.uint64(bits) | padded[w * per + k : w * per + k + len(codes)]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        code_of = {chr(c): i for i, c in enumerate(alphabet.tolist())}
        ids, low, high = [], [], []
        bounds: list[tuple[list[int], list[int]]] = []
        for i in self.usable.tolist():
            p = self.pieces[i]
            if all(c in code_of for c in p):
                lo, hi = [], []
                for w in range(-(-len(p) // per)):
                    a = b = 0
                    for k in range(w * per, w * per + per):
                        c = code_of[p[k]] if k < len(p) else None
                        a, b = a << bits | (c or 0), b << bits | ((1 << bits) - 1 if c is None else c)
                    lo.append(a)
                    hi.append(b)
                ids.append(i)
                bounds.append((lo, hi))
        if not ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.searchsorted(keys[0], np.array([x[0][0] for x in bounds], dtype=np.uint64), "left")
        high = np.searchsorted(keys[0], np.array([x[1][0] for x in bounds], dtype=np.uint64), "right")
        for j, (lo, hi) in enumerate(bounds):
            for w in range(1, len(lo)):
                if low[j] >= high[j]:
                    break
                part = keys[w][low[j] : high[j]]
                low[j], high[j] = low[j] + np.searchsorted(part, np.uint64(lo[w]), "left"), low[j] + np.searchsorted(part, np.uint64(hi[w]), "right")
        count = np.maximum(high - low, 0)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return suffixes[at], np.repeat(np.array(ids), count)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the two tokens' joined text gives just these two."""
        ok = np.ones(len(a), dtype=bool)
        lane, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), _NONE)
        while len(lane):
            crossed = self.pairs.get(a, b) < limit
            ok[lane[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            lane, a, b, ra, rb = lane[go], a[go], b[go], ra[go], rb[go]
            # Undo the later of the two merges; of equal ones the right one came later.
            left = ra > rb
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def _last_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, sizes, last): where each word starts in the joined text, its length, and the last token of the encoding of every prefix, at its end."""
        text = "\x00".join(words) + "\x00"
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes + 1) - sizes - 1
        word_of = np.repeat(np.arange(len(words)), sizes + 1)
        start, piece = self._edges(text)
        begin = first[word_of[start]]
        end = start + self.length[piece]
        reach = end - begin
        order = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 1 << 16 else reach, kind="stable")
        start, piece, end, begin, reach = start[order], piece[order], end[order], begin[order], reach[order]
        last = np.full(len(text) + 1, -1, dtype=np.int64)
        stops = np.searchsorted(reach, np.arange(1, int(sizes.max(initial=0)) + 2))
        for lo, hi in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            s, p, e = start[lo:hi], piece[lo:hi], end[lo:hi]
            opens = s == begin[lo:hi]
            fine = opens.copy()
            later = np.flatnonzero(~opens)
            fine[later] = self._may_follow(last[s[later]], p[later])
            last[e[fine]] = p[fine]
        return first, sizes, last

    def _relax(self, words: list[str]) -> list[bytes]:
        """Ids of words of known characters."""
        long = [w for w in words if len(w) > STRETCH + OVERLAP]
        if long:
            short = [w for w in words if len(w) <= STRETCH + OVERLAP]
            found = dict(zip(short, self._relax(short), strict=True)) if short else {}
            found |= {w: self._stitched(w) for w in long}
            return [found[w] for w in words]
        first, sizes, last = self._last_tokens(words)
        # Back from every word's end, all words at once.
        at, lane, took, lanes = first + sizes, np.arange(len(words)), [], []
        while len(lane):
            token = last[at]
            took.append(token)
            lanes.append(lane)
            at = at - self.length[token]
            go = at > first[lane]
            at, lane = at[go], lane[go]
        token, lane = np.concatenate(took[::-1]), np.concatenate(lanes[::-1])
        data = token[np.argsort(lane, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(lane, minlength=len(words)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _stitched(self, word: str) -> bytes:
        """Ids of a long word. Its stretches are relaxed side by side, each as if
        the word began there. A prefix's last token depends on those of the
        prefixes shorter by up to the longest piece, so where a stretch agrees
        with the one before on so many in a row, it is right from there on.
        Where one never does, as in a word that repeats a few characters, the
        word is merged pair by pair."""
        true = np.full(len(word) + 1, -1, dtype=np.int64)
        offsets, per = range(0, len(word), STRETCH), max(1, INDEX_CHARS // (STRETCH + OVERLAP))
        for k in range(0, len(offsets), per):
            group = offsets[k : k + per]
            first, sizes, last = self._last_tokens([word[o : o + STRETCH + OVERLAP] for o in group])
            for o, f, size in zip(group, first.tolist(), sizes.tolist(), strict=True):
                mine, right = last[f : f + size + 1], 1
                if o:
                    known = true[o : min(o + OVERLAP, len(word)) + 1]
                    equal = np.append(0, np.cumsum(known[1:] == mine[1 : len(known)]))
                    if len(known) > size:  # the word ends in the overlap
                        break
                    agreed = np.flatnonzero(equal[self.longest :] - equal[: -self.longest] == self.longest)
                    if not len(agreed):
                        return self._merged(word)
                    right = int(agreed[0]) + 1
                true[o + right : o + size + 1] = mine[right:]
        return self._traced(true)

    def _merged(self, word: str) -> bytes:
        """Ids of a word by its merges in order of rank, then place: the time is about that of a sort."""
        ids = [self.char_ids[c] for c in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = lambda i: self.merges.get((ids[i], ids[after[i]])) if after[i] < len(ids) else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has gone on
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def _traced(self, last: np.ndarray) -> bytes:
        tokens, length, at, out = last.tolist(), self.length.tolist(), len(last) - 1, []
        while at > 0:
            out.append(tokens[at])
            at -= length[tokens[at]]
        return np.array(out[::-1], dtype="<u4").tobytes()

    # -- texts

    def _bytes_of(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_fallback else [self.unknown]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words, as bytes. Words are encoded by parts where no piece
        could span the border; a character without a piece is its bytes."""
        unknown = set().union(*words) - self.chars
        alone = re.compile("([" + re.escape("".join(sorted(unknown))) + "])") if unknown else None
        known = self.chars.issuperset
        parts = {w: self.borders.split(w) if known(w) else [x for p in alone.split(w) if p for x in self.borders.split(p)] for w in words}
        out = {c: np.array(self._bytes_of(c), dtype="<u4").tobytes() for c in unknown}
        plain = sorted({x for ps in parts.values() for x in ps} - unknown - self.cache.keys())
        at = 0
        while at < len(plain):
            size, end = 0, at
            while end < len(plain) and (end == at or size < INDEX_CHARS):
                size += len(plain[end]) + 1
                end += 1
            out.update(zip(plain[at:end], self._relax(plain[at:end]), strict=True))
            at = end
        for w, ps in parts.items():
            if len(ps) > 1:
                out[w] = b"".join([x if (x := out.get(p)) is not None else self.cache[p] for p in ps])
            elif w not in out:
                out[w] = self.cache[w]
        return out

    def _words(self, text: str) -> list[str]:
        text = self.library.normalize(text)
        if not text:
            return []
        if not self.by_word:
            return [text]
        if SPACE * 2 in text or text[0] != SPACE or text[-1] == SPACE:
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        return [SPACE + w for w in text[1:].split(SPACE)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes; null is empty."""
        split = [self._words(t) if t else [] for t in texts]
        unseen: set[str] = set()
        for words in split:
            unseen.update(words)
        unseen -= self.cache.keys()
        fresh = self._learn(unseen) if unseen else {}
        cache = self.cache
        cache |= fresh
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w, ids in fresh.items():
            size = 2 * len(w) + len(ids) + 200
            if len(w) > CACHE_CHARS or self.cached + size > CACHE_BYTES:
                del cache[w]
            else:
                self.cached += size
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, runs of byte tokens read as UTF-8, the leading space that encoding adds removed."""
        if not len(ids):
            return ""
        low, high = self.first_byte, self.first_byte + 256
        if self.byte_fallback and ((ids >= low) & (ids < high)).any():
            out, run = [], bytearray()
            for i in ids.tolist():
                if low <= i < high:
                    run.append(i - low)
                    continue
                out += [run.decode("utf-8", "replace"), self.shown[i]]
                run = bytearray()
            text = "".join([*out, run.decode("utf-8", "replace")])
        else:
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec of the model at ``path``."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: Texts and characters that are encoded together at most.
_TEXTS, _CHARS = 4_000, 12_000_000


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHARS or i + 1 - first >= _TEXTS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text of ``docs``.

    Null and empty texts have no ids. Rows come out as they went in, repeated
    ones too; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                data = codec(path).encode(texts[lo:hi])
                ends = np.cumsum([0, *(len(x) // 4 for x in data)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return rows.mapInArrow(batches, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from rows of ids; null ids give an empty text."""
    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c = codec(path)
            texts = [c.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return picked.mapInArrow(batches, "doc_id long, text string")


def encode_and_check(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), round_trip (whether decoding gives
    the text back; false where the model's normaliser changes it).

    Null and empty texts have no ids, and a null counts as round trip; very
    long texts are encoded whole. Repeated rows each come out, null ids stay
    null, other columns are ignored, whatever their names; an empty table gives
    an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c, texts = codec(path), b.column(1).to_pylist()
            out = []
            for lo, hi in _groups(texts):
                for t, data in zip(texts[lo:hi], c.encode(texts[lo:hi]), strict=True):
                    ids = np.frombuffer(data, "<u4")
                    out.append((len(ids), zlib.crc32(data), c.decode(ids) == (t or "")))
            n, crc, same = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(batches, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
