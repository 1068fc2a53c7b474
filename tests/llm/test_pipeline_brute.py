"""The whole pipeline against its stages done one document at a time: SQL for the rules, a plain classifier, all pairs, texts redacted one by one, pieces cut by hand."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers

import corpus_pipeline
from latentspark.llm import pii, quality_classifier, quality_rules, simhash, tokens
from tests.llm.test_text_operators import _brute_classifier


def _groups(texts, width=5, similarity=0.8):
    """Least index of each text's group over all pairs."""
    sets = [set(simhash.shingle_hashes(t.encode(), width).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_pipeline_is_its_stages_one_by_one(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    passed = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.oracle()}) where kept").fetchall()}
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    labels = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").collect():
        labels.setdefault(r["doc_id"], []).append(r["quality"])
    labels = {k: np.mean(v) for k, v in labels.items() if np.mean(v) != 0.5}
    train = [r for r in docs if r["doc_id"] in labels]
    x = np.array([quality_classifier.features((r["text"] or "").encode()) for r in train])
    fit = quality_classifier.fit_logistic(x, np.array([float(labels[r["doc_id"]] > 0.5) for r in train]))
    rows = [r for r in docs if r["doc_id"] in passed]
    _, quality = _brute_classifier([(r["source"], r["lang"], r["text"]) for r in rows], *fit)
    assert np.abs(quality - 0.5).min() > 1e-6  # none is decided by rounding
    rows = [r for r, q in zip(rows, quality, strict=True) if q >= 0.5]
    rows = [r for k, (r, g) in enumerate(zip(rows, _groups([r["text"] for r in rows]), strict=True)) if g == k]
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = pii.train(pii.find_candidates(kept))
    encode, want = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).ids, Counter()
    for r in rows:
        ids, start, piece = np.append(encode(pii.redact_text(r["text"], model)), 2).astype("<u4"), 0, 0
        end = (len(ids) - 1) % 1024 + 1
        while start < len(ids):
            want[(r["doc_id"], piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
            piece, start, end = piece + 1, end, end + 1024
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) < len(docs) and Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
