"""License scanning by diagonal voting, with DataFrame functions only.

Every document is its words. All its rolling grams of ``GRAM`` words are joined, by
hash and then word for word, to the positions of the same grams in the license
templates. A match votes for a diagonal, its position in the document less that in the
template: an untouched copy is one diagonal, and each word put in or left out
moves what follows to a neighbouring one. Votes are counted by diagonal,
diagonals that lie close together are merged into a span, and a span is
verified by the share of the template's words that its matches cover. Only matches
move between tasks; texts stay where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentspark.llm.common import BROADCAST_ROWS

#: Words of a gram.
GRAM = 5
#: Diagonals that differ by at most this are one span.
SLACK = 8
#: Share of a template's words that a verified span covers, and of the grams that no template of another label has.
COVERED, OWN = 0.75, 0.5

#: What counts as a word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are labels of their own.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str


_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License
for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"""

#: License texts, headers and notices, whose wording is what is searched for.
TEMPLATES = (
    Template("mit-text", "mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""),
    Template("mit-notice", "mit", "released under the terms of the MIT License"),
    Template("apache-header", "apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-header", "gpl", _GNU.format("")),
    Template("gpl-notice", "gpl", "licensed under the GNU General Public License, version 3"),
    Template("lgpl-header", "lgpl", _GNU.format("Lesser ")),
    Template("agpl-header", "agpl", _GNU.format("Affero ")),
    Template("bsd-conditions", "bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""),
    Template("bsd-disclaimer", "bsd", _BSD),
    Template("isc-text", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-header", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("unlicense-text", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    Template("cc-by-notice", "cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by-sa-notice", "cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-nc-notice", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased.

    ``lower`` maps other letters too, to letters that are no less part of a
    word and in no template; the one that it would turn into a plain letter, the Kelvin sign,
    is put out of its way first."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("Å"))), F.lit(WORD), F.lit(0))


def _at(i: Column | int, column: str = "words") -> Column:
    return F.get(F.col(column), i if isinstance(i, Column) else F.lit(i))


def _grams(rows: DataFrame, gram: int) -> DataFrame:
    """``rows`` (with ``words``), once for each gram: its position ``pos`` and hash ``h``."""
    n = F.size("words")
    each = rows.select("*", F.explode(F.when(n >= gram, F.sequence(F.lit(0), n - gram))).alias("pos"))
    return each.withColumn("h", F.xxhash64(*(_at(F.col("pos") + i) for i in range(gram))))


def _template_rows(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(t.name).alias("template"), F.lit(t.label).alias("label"), F.lit(t.text).alias("text")) for t in templates))
    return spark.range(1, numPartitions=1).select(F.inline(rows)).select("template", "label", words(F.col("text")).alias("words"))


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(template, label, n_template, tpos, th, tgram, own, n_own): a row per gram of a template, and whether only its label has that gram."""
    rows = _grams(_template_rows(spark, templates), gram)
    rows = rows.select("template", "label", F.size("words").alias("n_template"), F.col("pos").alias("tpos"), F.col("h").alias("th"), F.slice("words", F.col("pos") + 1, F.lit(gram)).alias("tgram"))
    same, of = Window.partitionBy("th"), Window.partitionBy("template")
    rows = rows.withColumn("own", F.min("label").over(same) == F.max("label").over(same))
    return rows.withColumn("n_own", F.sum(F.col("own").cast("int")).over(of))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text's digest and the words of every row; both together name what was read."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.unhex(F.md5("text")).alias("digest"), words(F.col("text")).alias("words"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, template, label, first_word, end_word, votes, coverage, own_share: every merged span of every document that shares a gram with a template.

    Positions count words from 0. Coverage is the share of the template's words that matching
    grams cover. Null texts and texts shorter than a gram have no span; very long texts are
    read whole, and each of their spans is a group of its own with at most a template's positions; repeated rows have their spans once. Other columns are
    ignored, whatever their names; no rows or no templates long enough give no rows."""
    grams = template_grams(docs.sparkSession, templates, gram)
    bound = sum(len(t.text) for t in templates)  # a template has fewer grams than characters
    grams = F.broadcast(grams) if bound <= BROADCAST_ROWS else grams
    same = F.col("h") == F.col("th")
    for i in range(gram):
        same &= F.get("tgram", F.lit(i)) == _at(F.col("pos") + i)
    votes = _grams(_documents(docs, id_col, text_col), gram).join(grams, same)
    key = ["doc_id", "digest", "template", "label", "n_template", "n_own"]
    diagonals = votes.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set(F.struct("tpos", "own")).alias("hits"), F.min("pos").alias("first_word"), (F.max("pos") + gram).alias("end_word")
    )
    by = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(0))
    merged = diagonals.withColumn("far", far).withColumn("span", F.sum("far").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # A span has at most the template's positions, whatever the text's length.
    each = merged.select(*key, "span", "first_word", "end_word", F.explode("hits").alias("hit"))
    found = each.groupBy(*key, "span").agg(F.collect_set("hit").alias("hits"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["tpos"], x["tpos"] + (gram - 1))))))
    own = F.size(F.filter("hits", lambda x: x["own"]))
    return found.select(
        "doc_id", "digest", "template", "label", F.col("first_word").cast("long").alias("first_word"), F.col("end_word").cast("long").alias("end_word"), F.size("hits").alias("votes"),
        (covered / F.col("n_template")).alias("coverage"), F.when(F.col("n_own") > 0, own / F.col("n_own")).otherwise(1.0).alias("own_share"),
    )


def verified(found: DataFrame, covered: float = COVERED, own: float = OWN) -> DataFrame:
    """The spans that cover enough of their template, and enough of what is the license's own in it."""
    return found.where((F.col("coverage") >= covered) & (F.col("own_share") >= own))


def _places(phrase: tuple[str, ...], label: str) -> Column:
    """Starts of a phrase in ``words``; texts without its words aren't searched."""
    last = F.size("words") - len(phrase)
    may = F.array_contains("words", phrase[0]) & (last >= 0)
    for w in phrase[1:]:
        may &= F.array_contains("words", w)

    def here(i: Column) -> Column:
        out = _at(i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            out &= _at(i + j) == w
        return out

    found = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
    return F.when(may, found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def find(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, tuple[str, ...]], ...] = PHRASES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Base labels are those of ``phrases`` whose words stand consecutively anywhere; ``labels``
    adds the labels of verified spans. ``score`` is the largest coverage of a verified span, 0 without
    one. Null and empty texts have no words and no labels; null ids stay null; repeated rows each
    come out; very long texts are read whole. Other columns are ignored, whatever their names; an empty table gives
    an empty result."""
    read = _documents(docs, id_col, text_col).select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*(_places(w, label) for label, w in phrases))).alias("places"))
    base = read.select("doc_id", "digest", "n_words", F.transform("places", lambda x: x["at"]).alias("starts"), F.array_distinct(F.transform("places", lambda x: x["label"])).alias("named"))
    more = verified(spans(docs, templates, id_col=id_col, text_col=text_col)).groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g"))
    more = more.agg(F.collect_set("label").alias("matched"), F.max("coverage").alias("score"))
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        joined(F.col("named")).alias("base_labels"), joined(F.array_union("named", F.coalesce("matched", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM, slack: int = SLACK, covered: float = COVERED, own: float = OWN) -> str:
    """DuckDB SQL for :func:`find` over ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    split = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    rolled = lambda key, table, pos: f"select {key}, p as {pos}, array_to_string(w[p + 1 : p + {gram}], ' ') as g from (select *, unnest(range(len(w) - {gram - 1})) as p from {table} where len(w) >= {gram})"
    places = " union all ".join(f"select doc_id, {quoted(lab)} as label, list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(ph)}] = {list(ph)}) as found from d" for lab, ph in PHRASES)
    return f"""with d as materialized (select doc_id, {split("coalesce(text, '')")} as w from documents),
    t as materialized (select template, label, {split("text")} as w from (values {", ".join(f"({quoted(x.name)}, {quoted(x.label)}, {quoted(x.text)})" for x in templates)}) v(template, label, text)),
    tg as materialized (select *, (min(label) over (partition by g) = max(label) over (partition by g))::int as own from ({rolled("template, label, len(w) as n", "t", "tpos")})),
    votes as (select distinct doc_id, template, label, n, pos, tpos, own from ({rolled("doc_id", "d", "pos")}) join tg using (g)),
    runs as (select *, sum(far) over (partition by doc_id, template order by dg) as span from (
      select *, coalesce((dg - lag(dg) over (partition by doc_id, template order by dg) > {slack})::int, 0) as far from (select distinct doc_id, template, pos - tpos as dg from votes))),
    hits as (select distinct doc_id, template, label, n, span, tpos, own from votes join runs using (doc_id, template) where dg = pos - tpos),
    sp as (select doc_id, template, label, n, span, sum(own) as mine, len(list_distinct(flatten(list(range(tpos, tpos + {gram}))))) / n::double as coverage from hits group by doc_id, template, label, n, span),
    ok as (select doc_id, list(distinct label) as labels, max(coverage) as score from sp join (select template, sum(own) as n_own from tg group by 1) using (template)
      where coverage >= {covered} and (n_own = 0 or mine / n_own::double >= {own}) group by 1),
    b as (select doc_id, list(label) filter (where len(found) > 0) as labels, sum(len(found))::bigint as n_base, min(list_min(found)) as first_word, max(list_max(found)) as last_word from ({places}) group by 1)
    select d.doc_id, len(w)::bigint as n_words, n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(ok.labels, [])))), ','), '') as labels, coalesce(score, 0::double) as score
    from d join b using (doc_id) left join ok using (doc_id)"""
