"""License scans against a plain scan, with copies, changed copies, look-alikes and odd tables."""

import random
import re

import pytest

from latentspark.llm import license_scan as ls
from tests.llm.cases import no_documents, odd_documents, prose

BY_NAME = {t.name: t for t in ls.TEMPLATES}


def _words(text):
    return re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(text, templates=ls.TEMPLATES):
    """What ``find`` returns for one text, by loops over positions."""
    w, k = _words(text), ls.GRAM
    places = [(i, lab) for lab, p in ls.PHRASES for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    grams = {}
    for t in templates:
        tw = _words(t.text)
        for j in range(len(tw) - k + 1):
            grams.setdefault(tuple(tw[j : j + k]), []).append((t, j))
    own = {g: len({t.label for t, _ in at}) == 1 for g, at in grams.items()}
    n_own = {t.name: sum(own[g] for g, at in grams.items() for u, _ in at if u is t) for t in templates}
    votes = {}
    for i in range(len(w) - k + 1):
        for t, j in grams.get(tuple(w[i : i + k]), ()):
            votes.setdefault(t, {}).setdefault(i - j, set()).add((j, own[tuple(w[i : i + k])]))
    labels, score = set(), 0.0
    for t, by in votes.items():
        runs, last = [], None
        for d in sorted(by):
            if last is None or d - last > ls.SLACK:
                runs.append(set())
            runs[-1] |= by[d]
            last = d
        for hits in runs:
            cover = len({j + i for j, _ in hits for i in range(k)}) / len(_words(t.text))
            if cover >= ls.COVERED and (not n_own[t.name] or sum(o for _, o in hits) / n_own[t.name] >= ls.OWN):
                labels.add(t.label)
                score = max(score, cover)
    base = {lab for _, lab in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def _texts():
    r = random.Random(5)
    out = {0: prose(0, 300), 1: "The MIT License, an apache LICENSE and the general  public\nlicense; mit license"}
    for n, t in enumerate(ls.TEMPLATES):
        out[10 + n] = f"{prose(n, 40)}\n# {t.text}\n{prose(n + 50, 40)}"
        w = t.text.split()
        for _ in range(len(w) // 25):  # words changed, put in, left out
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([["changed"], [], [w[i], "more"]])
        out[40 + n] = prose(n, 20) + " " + " ".join(w)
        out[70 + n] = " ".join(sorted(w, key=lambda x: r.random()))  # its words in another order
        out[100 + n] = " ".join(w[: max(6, len(w) // 2)])  # half of it
    out[200] = (BY_NAME["mit-text"].text + " and ") * 40
    out[201] = "x " * 5000 + BY_NAME["apache-notice"].text
    out[202] = "Kelvin's worK is licensed under CC BY-NC 4.0, İ \U0001f600 été\x00mit\x7flicense"
    out[203] = BY_NAME["gpl-header"].text.replace("General", "Lesser General")
    return out


def test_same_as_a_plain_scan(spark):
    texts = _texts()
    got = ls.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(_plain(texts[r["doc_id"]])), r["doc_id"]


def test_copies_are_found_and_look_alikes_left(spark):
    texts = _texts()
    got = {r["doc_id"]: r for r in ls.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for n, t in enumerate(ls.TEMPLATES):
        assert t.label in got[10 + n]["labels"].split(",") and got[10 + n]["score"] == 1.0
        if len(t.text) > 150:
            assert got[40 + n]["labels"].split(",").count(t.label) == 1 and got[40 + n]["score"] >= ls.COVERED
            assert got[70 + n]["score"] == 0 and (got[100 + n]["score"] == 0 or t.name == "apache-header")  # which begins with the whole notice
    assert got[0]["labels"] == "" and got[200]["labels"] == "mit" and got[202]["labels"] == "cc-by-nc,mit" 
    assert got[203]["base_labels"] == "gpl" and got[203]["labels"] == "gpl,lgpl" and got[203]["score"] == 1.0


def test_spans_lie_where_the_copy_is(spark):
    t = BY_NAME["isc-text"]
    n = len(_words(t.text))
    df = spark.createDataFrame([(1, "a b c " * 10 + t.text + " d e " * 30 + t.text)], "doc_id long, text string")
    got = sorted((r["first_word"], r["end_word"], r["coverage"]) for r in ls.verified(ls.spans(df)).where("template = 'isc-text'").collect())
    assert got == [(30, 30 + n, 1.0), (90 + n, 90 + 2 * n, 1.0)]


def test_odd_tables(spark):
    rows = odd_documents(spark, [(None, "MIT License", None, None, None), (9, BY_NAME["bsd-conditions"].text, "en", "s", 1), (9, BY_NAME["bsd-conditions"].text, "en", "s", 1)])
    got = ls.find(rows).collect()
    assert len(got) == rows.count()
    assert [(r["labels"], r["score"]) for r in got if r["doc_id"] == 9] == [("bsd", 1.0)] * 2
    assert sorted(r["labels"] for r in got if r["doc_id"] is None) == ["", "", "mit"]
    assert all(r["n_words"] == 0 and r["n_base"] == 0 and r["first_word"] is None and r["base_labels"] == "" for r in got if r["doc_id"] in (3, 4, 5))
    assert ls.find(no_documents(spark)).count() == 0 and ls.spans(no_documents(spark)).count() == 0


def test_no_python_workers_on_the_way(spark):
    plan = ls.find(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
