"""Quality rules with adaptive thresholds.

Every document gets counts; ratios of them, as integers, go into one
mergeable quantile sketch per language and source. Thresholds come from the
sketches' quantiles instead of fixed cutoffs and are joined back to filter.
A sketch is a histogram whose bins keep the eleven leading bits of a value:
exact below 2048, within 0.1 % above. Sketches merge by adding counts, so a
group's sketch is one partially aggregated ``groupBy``, and a sparse group
takes its language's or the corpus's sketch, summed from the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latentspark.llm.common import in_small_batches, keyed, sized_broadcast, sliced, written

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))

#: Metric: (part, whole, units of the ratio, size, events). A threshold is the upper end of the
#: widest stretch of a group's sketch, above its median, that hardly any document falls
#: into: what lies beyond is set apart from all others. A group that has no such stretch
#: and whose upper quartile is 0 takes that of its language or the corpus; without any, a threshold lies ten
#: times the upper quartile's distance from the median above that quartile. It is never
#: less than so many events in a document of the group's median size, so that no
#: document goes for a few.
RULES = {
    "symbol_permille": ("n_symbols", "word_chars", 1000, "word_chars", 20),  # symbols to word characters
    "dup_line_permille": ("n_dup_lines", "n_lines", 1000, "n_lines", 3),  # lines equal to an earlier line
    "repeat_permille": ("n_repeat_words", "n_words", 1000, "n_words", 80),  # words in repeated 3-word windows
    "upper_permille": ("n_upper", "word_chars", 1000, "word_chars", 30),  # A-Z to word characters
    "word_length_centi": ("word_chars", "n_words", 100, "n_words", 0),  # mean word length, hundredths
}
TIMES = 10
#: A stretch is cut into levels, four to a doubling of 1 + value. It counts from so many levels on, more where it begins at
#: 0; levels with under one document in ``THIN`` are empty; at most one document in ``APART`` lies beyond it.
WIDE, WIDE_FROM_ZERO, THIN, APART = 8, 16, 500, 4
#: Sizes of documents, sketched like the metrics.
SIZES = tuple(dict.fromkeys(r[3] for r in RULES.values()))
#: Groups with fewer documents take the sketch one level up.
MIN_GROUP = 50

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The counts in ``STATS`` of one UTF-8 text; null has none of anything."""
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    upper = len(text) - len(text.translate(None, _UPPER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
        marked = np.zeros(n, dtype=bool)
        for k in range(3):
            marked[at + k] = True
        repeated = int(marked.sum())
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper)


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its counts."""
    for b in sliced(batches):
        stats = np.array([text_stats(t) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.int64).reshape(-1, 7)
        names = [x.split()[0] for x in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(stats[:, k]) for k in range(7))], [*b.schema.names[:-1], *names])


def with_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the counts of its texts."""
    rows = docs.select(*(keep or []), F.col(text_col).cast("string").cast("binary").alias("__text"))
    return in_small_batches(rows).mapInArrow(_stat_batches, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(STATS).fields]))


def metrics() -> dict:
    """The rules' metrics as integer columns over the counts; nothing over nothing is 0."""
    return {k: F.expr(f"case when {whole} > 0 then ({units} * {part}) div {whole} else 0 end") for k, (part, whole, units, _, _) in RULES.items()}


def sketch(stats: DataFrame) -> DataFrame:
    """(lang_key, source_key, metric, bin, n): one sketch per language, source and metric or size."""
    every = metrics() | {k: F.col(k) for k in SIZES}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in every.items()))).alias("m")
    low_bits = "greatest(length(bin(m.v)) - 11, 0)"
    return (
        stats.select("lang_key", "source_key", pairs)
        .select("lang_key", "source_key", "m.metric", F.expr(f"shiftleft(shiftright(m.v, {low_bits}), {low_bits})").alias("bin"))
        .groupBy("lang_key", "source_key", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, q50, q75): the least bin with at least that share of a sketch's count at or below it."""
    w = Window.partitionBy(*keys, "metric")
    return (
        sketches.withColumn("upto", F.sum("n").over(w.orderBy("bin")))
        .withColumn("all", F.sum("n").over(w))
        .groupBy(*keys, "metric")
        .agg(F.max("all").alias("n"), *(F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bin"))).alias(f"q{q}") for q in (50, 75)))
    )


def _level(v: str) -> str:
    """The level of a value: four to a doubling of one more than it."""
    u, n = f"({v} + 1)", f"(length(bin({v} + 1)) - 1)"
    return f"(4 * {n} + shiftright(4 * {u}, {n}) - 4)"


def stretches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, edge): the largest value below what a sketch's widest near-empty stretch above the median sets apart; no row without one."""
    levels = sketches.withColumn("level", F.expr(_level("bin"))).groupBy(*keys, "metric", "level").agg(F.sum("n").alias("n"), F.min("bin").alias("low"))
    w = Window.partitionBy(*keys, "metric")
    full = levels.withColumn("upto", F.sum("n").over(w.orderBy("level"))).withColumn("all", F.sum("n").over(w)).where(F.col("n") * THIN >= F.col("all"))
    follows = w.orderBy("level")
    gaps = full.withColumn("gap", F.lead("level").over(follows) - F.col("level")).withColumn("edge", F.lead("low").over(follows) - 1)
    wide = F.when(F.col("level") == 0, WIDE_FROM_ZERO).otherwise(WIDE)
    found = gaps.where((F.col("gap") >= wide) & (F.col("upto") * 2 >= F.col("all")) & ((F.col("all") - F.col("upto")) * APART <= F.col("all")))
    return found.groupBy(*keys, "metric").agg(F.max(F.struct("gap", (-F.col("level")).alias("low_first"), "edge"))["edge"].alias("edge"))


def thresholds(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang_key, source_key) with an upper threshold per metric, from
    its own sketch, or its language's or the corpus's where
    it has fewer than ``min_group`` documents."""
    own = written(sketch(stats), "sketch")
    by_lang, over_all = merged(own, "lang_key"), merged(own)
    group = quantiles(own, ["lang_key", "source_key"]).join(stretches(own, ["lang_key", "source_key"]), ["lang_key", "source_key", "metric"], "left")
    lang = quantiles(by_lang, ["lang_key"]).join(stretches(by_lang, ["lang_key"]), ["lang_key", "metric"], "left")
    lang = lang.select("lang_key", "metric", *(F.col(x).alias(f"l_{x}") for x in ("n", "q50", "q75", "edge")))
    every = quantiles(over_all, []).join(stretches(over_all, []), "metric", "left").select("metric", *(F.col(x).alias(f"e_{x}") for x in ("q50", "q75", "edge")))
    level = lambda q: F.when(F.col("n") >= min_group, F.col(q)).when(F.col("l_n") >= min_group, F.col(f"l_{q}")).otherwise(F.col(f"e_{q}"))
    above = F.coalesce(F.when(F.col("l_n") >= min_group, F.col("l_edge")), F.col("e_edge"))
    edge = F.coalesce(F.when(F.col("n") >= min_group, F.col("edge")), F.when(level("q75") == 0, above))
    known = (
        group.join(lang, ["lang_key", "metric"]).join(F.broadcast(every), "metric")
        .groupBy("lang_key", "source_key")
        .pivot("metric", [*RULES, *SIZES])
        .agg(F.first(level("q50")).alias("q50"), F.first(level("q75")).alias("q75"), F.first(edge).alias("edge"))
    )

    def limit(k: str, units: int, size: str, events: int) -> Column:
        least = f"{events * units} div greatest({size}_q50, 1)"
        return F.expr(f"case when {k}_edge is not null then greatest({k}_edge, {least}) else {k}_q75 + {TIMES} * ({k}_q75 - {k}_q50) + {least} end")

    return known.select("lang_key", "source_key", *(limit(k, units, size, events).cast("long").alias(f"max_{k}") for k, (_, _, units, size, events) in RULES.items()))


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def over(k: str, v: Column) -> Column:
    """Whether a metric is over its group's threshold."""
    return v > F.coalesce(F.col(f"max_{k}"), F.lit(2**62))


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with base_failed and kept. A document is kept if it passes the
    base rules and no metric is over its group's threshold."""
    any_over = F.lit(False)
    for k, v in metrics().items():
        any_over = any_over | over(k, v)
    return stats.join(sized_broadcast(limits), ["lang_key", "source_key"], "left").withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~any_over)


def removals(scored: DataFrame) -> DataFrame:
    """(rule, over_it, only_it): how many documents that pass the base rules each rule rejects, and how many no other does."""
    flags = F.array(*(F.when(over(k, v), F.lit(k)) for k, v in metrics().items()))
    each = scored.where("not base_failed").select(F.array_compact(flags).alias("rules"))
    return each.select(F.explode("rules").alias("rule"), (F.size("rules") == 1).alias("only")).groupBy("rule").agg(F.count("*").alias("over_it"), F.count_if("only").alias("only_it"))


def _keyed_stats(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    base = docs.withColumn("lang_key", keyed(lang_col)).withColumn("source_key", keyed(source_col))
    return with_stats(base, text_col, [*keep, "lang_key", "source_key"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, the ratios' thresholds, base_failed, kept.

    Null and empty texts have no words, so they fail the base rule; very long
    ones are counted whole. Null languages or sources are groups of their own.
    A ratio equal to its threshold passes. Repeated rows count and come out as
    often as they went in; an empty table gives an empty result; other columns
    are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = written(_keyed_stats(rows, ["doc_id"], "text", "lang", "source"), "stats")
    return judged(stats, written(thresholds(stats, min_group), "limits")).drop("lang_key", "source_key")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.

    Rows with null or empty texts go, as the base rule says; nulls elsewhere,
    repeated rows, ties and very long texts as in :func:`score`. Columns may
    have any name; an empty table stays empty.

    Counts are made twice, once for the sketches and once next to the whole
    row, so that no text is shuffled or stored."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("__row"), F.col(text_col).alias("__t"), F.col(lang_col).alias("__l"), F.col(source_col).alias("__s"))
    limits = written(thresholds(_keyed_stats(rows, [], "__t", "__l", "__s"), min_group), "limits")
    return judged(_keyed_stats(rows, ["__row"], "__t", "__l", "__s"), limits).where("kept").select("__row.*")


def oracle(min_group: int = MIN_GROUP) -> str:
    """DuckDB SQL of ``score`` over ``documents``."""
    space = "\\x09-\\x0D\\x20"
    values = ", ".join(f"case when {b} > 0 then ({u} * {a}) // {b} else 0 end as {k}" for k, (a, b, u, _, _) in RULES.items())
    long_ = " union all ".join(f"select lang_key, source_key, '{k}' as metric, {k} as v from m" for k in (*RULES, *SIZES))
    q = lambda k, x: f"max(case when metric = '{k}' then {x} end)"
    least = lambda u, z, e: f"{u * e} // greatest({q(z, 'q50')}, 1)"
    limits = ", ".join(
        f"""(case when {q(k, "edge")} is not null then greatest({q(k, "edge")}, {least(u, z, e)})
        else {q(k, "q75")} + {TIMES} * ({q(k, "q75")} - {q(k, "q50")}) + {least(u, z, e)} end)::bigint as max_{k}""" for k, (_, _, u, z, e) in RULES.items()
    )
    over = " or ".join(f"{k} > max_{k}" for k in RULES)

    def quant(name: str, keys: str) -> str:
        part = ", ".join(x for x in (keys, "metric") if x)
        return f"""
      {name}_b as (select {part}, bin, sum(n) as n from bins group by {part}, bin),
      {name}_c as (select *, sum(n) over (partition by {part} order by bin) as upto, sum(n) over (partition by {part}) as total from {name}_b),
      {name}_q as (select {part}, max(total) as n, min(case when upto * 100 >= total * 50 then bin end) as q50,
        min(case when upto * 100 >= total * 75 then bin end) as q75 from {name}_c group by {part}),
      {name}_l as (select {part}, 4 * (length(bin(bin + 1)) - 1) + ((4 * (bin + 1)) >> (length(bin(bin + 1)) - 1)) - 4 as level, sum(n) as n, min(bin) as low from {name}_b group by all),
      {name}_f as (select * from (select *, sum(n) over (partition by {part} order by level) as upto, sum(n) over (partition by {part}) as total from {name}_l) where n * {THIN} >= total),
      {name}_g as (select *, lead(level) over (partition by {part} order by level) - level as gap, lead(low) over (partition by {part} order by level) - 1 as edge from {name}_f),
      {name}_e as (select {part}, edge from {name}_g where gap >= case when level = 0 then {WIDE_FROM_ZERO} else {WIDE} end and upto * 2 >= total and (total - upto) * {APART} <= total
        qualify row_number() over (partition by {part} order by gap desc, level) = 1),
      {name} as (select * from {name}_q left join {name}_e using ({part}))"""

    return f"""
      with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(lang, '~null') as lang_key, coalesce(source, '~null') as source_key from documents),
      t as (select *, regexp_extract_all(text, '[^{space}]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as lines from d),
      c as (select r, doc_id, lang_key, source_key, w, len(w)::bigint as n_words, length(regexp_replace(text, '[{space}]', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper from t),
      win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select r, w, unnest(range(1, n_words - 1)) as i from c where n_words >= 3)),
      rep as (select r, i from (select r, i, count(*) over (partition by r, s) as k from win) where k > 1),
      marked as (select r, count(distinct i + o)::bigint as n_repeat_words from rep, (select unnest([0, 1, 2]) as o) group by r),
      s as (select c.*, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from c left join marked using (r)),
      m as (select *, {values} from s),
      bins as (select lang_key, source_key, metric, (v >> greatest(length(bin(v)) - 11, 0)) << greatest(length(bin(v)) - 11, 0) as bin, count(*) as n from ({long_}) group by all),
      {quant("g", "lang_key, source_key")}, {quant("l", "lang_key")}, {quant("e", "")},
      q as (select g.lang_key, g.source_key, g.metric,
        case when g.n >= {min_group} then g.q50 when l.n >= {min_group} then l.q50 else e.q50 end as q50,
        case when g.n >= {min_group} then g.q75 when l.n >= {min_group} then l.q75 else e.q75 end as q75,
        coalesce(case when g.n >= {min_group} then g.edge end, case when case when g.n >= {min_group} then g.q75 when l.n >= {min_group} then l.q75 else e.q75 end = 0
          then coalesce(case when l.n >= {min_group} then l.edge end, e.edge) end) as edge
        from g join l on g.lang_key = l.lang_key and g.metric = l.metric join e on g.metric = e.metric),
      lims as (select lang_key, source_key, {limits} from q group by lang_key, source_key)
      select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, {", ".join(f"max_{k}" for k in RULES)},
        (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not ({over}) as kept
      from m join lims using (lang_key, source_key)"""
