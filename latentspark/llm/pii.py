"""Personal data by weak supervision.

Base patterns give spans that always stand. Wider candidates (local phone
numbers, social security numbers, bank accounts, spelled-out mail addresses,
names, street addresses) are voted on by independent labelers: strict pattern,
gazetteer, cue words before, contradicting context, checksum. Expectation maximisation over the counts of
vote patterns estimates each labeler's reliability per kind; the resulting
posteriors train the final span classifier (naive Bayes over span shape and
context), whose weights come from grouped sums. The driver sees only tables
whose size is fixed by the labelers and the feature space.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import in_small_batches, sliced, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "name", "iban", "address")
LABELERS = ("pattern", "gazetteer", "cue", "context", "checksum")
FEATURE_SPACE = 1 << 12
#: A candidate is added if classifier and vote posterior both reach this.
THRESHOLD = 0.5

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at every later digit too, so looking at starts only keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? ([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){1,2})")
_NAME_HINTS = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")
_CAPITALS = re.compile(r"(?<![\w.])[A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){1,2}(?!\w)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_STREET = re.compile(
    r"(?<![\w.])[0-9]{1,5}[a-z]? (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Boulevard|Blvd|Drive|Court|Square|Way)\b"
    r"|(?<!\w)[A-ZÄÖÜ][a-zäöüß]{1,24}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?(?!\w)"
    r"|(?<![\w.])[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:de |du |des |la |le )*[A-ZÉ][\wé'-]{1,20}(?!\w)"
    r"|(?<!\w)(?:Calle|Avenida|Plaza) (?:de |del |la )*[A-Z]\w{1,20},? [0-9]{1,4}(?!\w)"
)

#: Gazetteers, fixed values.
_TLDS = frozenset("com org net edu gov io co uk de fr es it nl eu info".split())
_FIRST_NAMES = frozenset(
    """james mary john linda robert susan michael karen david sarah william lisa richard nancy joseph betty thomas helen charles sandra daniel donna matthew carol anthony ruth mark sharon
    paul michelle steven laura andrew emily kenneth kimberly george deborah kevin jessica brian amy edward anna peter hans klaus jürgen wolfgang stefan andreas maria ursula monika petra
    sabine claudia jean pierre michel philippe claire marie isabelle sophie nathalie camille juan carlos jose luis miguel javier carmen ana isabel lucia sofia elena julia pablo diego""".split()
)
_IBAN_SIZES = dict(zip("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split(), (20, 16, 21, 24, 22, 18, 24, 18, 27, 22, 22, 27, 20, 18, 15, 28, 25, 24), strict=True))
_CUES = {
    "email": ("mail", "contact", "write to", "courriel", "correo"),
    "ip": ("ip", "server", "host", "address", "client"),
    "card": ("card", "visa", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "name": ("name", "dear", "signed", "regards", "contact", "patient", "customer", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "sr"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "transfer"),
    "address": ("address", "lives at", "live at", "ship to", "located at", "wohnt", "adresse", "habite", "vive en", "domicilio"),
}
_AGAINST = ("version", "isbn", "order no", "invoice", "ticket", "part no", "serial", "section", "release")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind: leftmost
    non-overlapping within a kind, matches that fail a check dropped."""
    spans = []
    free = 0
    for run in _LOCAL.finditer(text):
        start, at = max(run.start(), free), run.end() - 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((start, 0, m.end()))
            free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def iban_sound(account: str) -> bool:
    """Whether the check digits of an account without spaces are right (remainder one by 97)."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    if _DIGIT.search(text):
        yield from ((m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text))
        yield from ((m.start(), 4, m.end()) for m in _SSN.finditer(text))
    if any(x in text for x in ("(at)", "[at]", "(AT)", "[AT]")):
        yield from ((m.start(), 0, m.end()) for m in _SPELLED.finditer(text))
    if any(x in text for x in _NAME_HINTS):
        yield from ((m.start(1), 5, m.end(1)) for m in _NAME.finditer(text))
    for m in _CAPITALS.finditer(text):  # untitled names: a known first name, or a cue
        if m[0].split(" ", 1)[0].lower() in _FIRST_NAMES or _cued(text[max(0, m.start() - 40) : m.start()].lower(), "name"):
            yield m.start(), 5, m.end()
    if _DIGIT.search(text):
        yield from ((m.start(), 6, m.end()) for m in _IBAN.finditer(text))
        yield from ((m.start(), 7, m.end()) for m in _STREET.finditer(text))


def _cued(before: str, name: str) -> bool:
    """Whether one of the kind's cues stands as a word shortly before."""
    return any(c in before and re.search(rf"(?<!\w){c}s?(?!\w)", before) for c in _CUES[name])


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """One vote per labeler: 1 for, -1 against, 0 abstains."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    after = text[end : end + 20].lower()
    digits = "".join(c for c in span if "0" <= c <= "9")
    words = re.findall(r"[a-z0-9-]+", span.lower())
    name = KINDS[kind]
    strict = 1 if base else 0
    if name == "ssn":
        strict = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    elif name == "phone" and "(" in span:
        strict = 1
    elif name in ("iban", "address"):
        strict = 1
    known = 0
    if name == "email":
        known = 1 if words and words[-1] in _TLDS else -1
    elif name == "name":
        known = 1 if span.split(" ", 1)[0].lower() in _FIRST_NAMES else 0
    elif name == "iban":
        known = 1 if _IBAN_SIZES.get(span[:2]) == len(span.replace(" ", "")) else -1
    elif name == "ip":
        known = 1 if span.startswith(("10.", "192.168.", "172.16.")) else 0
    cue = 1 if _cued(before, name) else 0
    against = -1 if any(c in before for c in _AGAINST) or after[:1].isalnum() or before[-1:].isalnum() else 1
    check = 0
    if name == "card":
        check = 1 if luhn(digits) else -1
    elif name == "phone":
        check = 1 if 10 <= len(digits) <= 15 and len(set(digits)) > 3 else -1
    elif name == "ssn":
        check = 1 if len(set(digits)) > 2 and digits[5:] != "0000" else -1
    elif name == "iban":
        check = 1 if iban_sound(span.replace(" ", "")) else -1
    return [strict, known, cue, against, check]


def _bucket(kind: int, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr((kind, *what)).encode(), digest_size=4).digest(), "little") % FEATURE_SPACE


def _span_features(text: str, start: int, kind: int, end: int) -> list[int]:
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", span)))[:24]
    left = re.findall(r"\w+", text[max(0, start - 24) : start])
    right = re.findall(r"\w+", text[end : end + 24])
    return [_bucket(kind, "shape", shape), _bucket(kind, "size", min(end - start, 40) // 4), _bucket(kind, "left", left[-1].lower() if left else ""), _bucket(kind, "right", right[0].lower() if right else "")]


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and all candidates with votes (as a base-3 number) and features. Wider candidates that touch a base span are not candidates."""
    base = base_spans(text)
    found = [(s, True) for s in base]
    starts, ends, end_of = [], [], -1
    for start, _, end in base:  # as disjoint stretches
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for s in sorted(_wider(text)):
        at = bisect_left(starts, s[2]) - 1  # the last stretch that starts before its end
        if s[0] >= end_of and (at < 0 or ends[at] <= s[0]):
            found.append((s, False))
            end_of = s[2]
    out = []
    for (start, kind, end), is_base in found:
        code = 0
        for v in votes(text, start, kind, end, is_base):
            code = code * 3 + v + 1
        out.append({"kind": kind, "start": start, "end": end, "votes": code, "base": is_base, "features": _span_features(text, start, kind, end)})
    return base, out


CANDIDATES = "array<struct<kind:int,start:int,end:int,votes:int,base:boolean,features:array<int>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("base", pa.bool_()), ("features", pa.list_(pa.int32()))]))


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        found = [candidates(t or "")[1] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], ["doc_id", "found"])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows).mapInArrow(_candidate_batches, f"doc_id long, found {CANDIDATES}")


def vote_posteriors(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, vote pattern) by expectation maximisation.

    Labelers are independent given the truth; each has, per kind, a probability
    of every vote for true and for false spans. Starts from the votes' mean."""
    out: dict[tuple[int, int], float] = {}
    patterns = np.array(list(product((0, 1, 2), repeat=len(LABELERS))))
    for kind in {k for k, _ in counts}:
        codes = sorted(c for k, c in counts if k == kind)
        n = np.array([counts[kind, c] for c in codes], dtype=float)
        v = patterns[codes]
        p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))
        for _ in range(rounds):
            share = (n @ p + 1) / (n.sum() + 2)
            like = np.tile([np.log(share), np.log(1 - share)], (len(n), 1))
            for k in range(v.shape[1]):
                for side, w in enumerate((n * p, n * (1 - p))):
                    # Prior votes say that labelers are better than chance.
                    prior = np.array([1.0, 2.0, 4.0] if side == 0 else [4.0, 2.0, 1.0])
                    rate = np.bincount(v[:, k], weights=w, minlength=3) + prior
                    like[:, side] += np.log(rate / rate.sum())[v[:, k]]
            new = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -30, 30)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        out.update({(kind, c): float(x) for c, x in zip(codes, p, strict=True)})
    return out


class SpanModel:
    """Vote posteriors and naive Bayes weights; bounded by labelers and ``FEATURE_SPACE``."""

    def __init__(self, posteriors: dict[tuple[int, int], float], weights: np.ndarray, prior: dict[int, float]):
        self.posteriors, self.weights, self.prior = posteriors, weights, prior

    def accepts(self, c: dict) -> bool:
        if c["base"]:
            return True
        p = self.posteriors.get((c["kind"], c["votes"]), 0.0)
        score = self.prior.get(c["kind"], 0.0) + float(self.weights[c["features"]].sum())
        return p >= THRESHOLD and score >= np.log(THRESHOLD / (1 - THRESHOLD))


def train(found: DataFrame) -> SpanModel:
    """The model from a table of candidates, by two grouped aggregations."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).toLocalIterator()}
    posteriors = vote_posteriors(counts)
    prior = {}
    for kind in {k for k, _ in counts}:
        n = sum(x for (k, _), x in counts.items() if k == kind)
        s = sum(x * posteriors[k, c] for (k, c), x in counts.items() if k == kind)
        prior[kind] = float(np.log((s + 1) / (n - s + 1)))
    weights = np.zeros(FEATURE_SPACE)
    if counts:
        table = found.sparkSession.createDataFrame([(k, c, p) for (k, c), p in posteriors.items()], "kind int, votes int, p double")
        sums = each.join(F.broadcast(table), ["kind", "votes"]).select("kind", "p", F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
        for r in sums.toLocalIterator():
            weights[r["f"]] = np.log((r["s"] + 1) / (r["n"] - r["s"] + 1)) - prior[r["kind"]]
    return SpanModel(posteriors, weights, prior)


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _span_batches(batches: Iterator[pa.RecordBatch], model: SpanModel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for found in b.column(1).to_pylist():
            base = [(c["start"], c["kind"], c["end"]) for c in found if c["base"]]
            kept = [(c["start"], c["kind"], c["end"]) for c in found if model.accepts(c)]
            n = [sum(k == x for _, k, _ in base) for x in range(4)]
            rows.append((*n, hashlib.sha256(_spelled(base).encode()).hexdigest(), _spelled(kept)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (kind:start:end, comma-joined; code points, end exclusive).

    Null texts are empty and have no spans; very long texts are read whole, in
    time proportional to their length. Of candidates that overlap the first
    counts. Null ids stay null; repeated rows each come out; other columns are
    ignored, whatever their names; an empty table gives an empty result."""
    found = written(find_candidates(docs, id_col, text_col), "candidates")
    model = train(found)
    return found.mapInArrow(
        lambda it: _span_batches(it, model),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redact_text(text: str, model: SpanModel) -> str:
    """``text`` with every accepted span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, end in sorted((c["start"], c["kind"], c["end"]) for c in candidates(text)[1] if model.accepts(c)):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind: [EMAIL], [IP], [CARD], [PHONE], [SSN], [NAME], [IBAN] or [ADDRESS].

    Spans that overlap become one, named by the first; very long texts are read whole. Nulls stay null; empty texts, all other columns, whatever their names, and
    all rows, repeated ones too, stay as they are; an empty table stays empty."""
    model = train(written(find_candidates(docs, id_col, text_col), "candidates"))
    rows = docs.select(F.struct(*(c for c in docs.columns if c != text_col), F.lit(1).alias("__one")).alias("rest"), F.col(text_col).cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            clean = [None if t is None else redact_text(t, model) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string())], ["rest", "text"])

    got = in_small_batches(rows).mapInArrow(batches, rows.schema)
    return got.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))
