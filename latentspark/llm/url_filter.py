"""URL filtering by pattern rules, with DataFrame functions only.

Each rule names literal tokens that stand whole in every URL it matches. Rules
are indexed by the one of these that is rarest in the URLs at hand; a URL's
tokens fetch candidate rules, and only those run their regular expression. A rule
that names no token is a candidate for every URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import BROADCAST_ROWS

#: Stands for a token that every URL has.
ALWAYS = "*"
#: Rules up to which the index is part of the plan, where a token is looked for from its front; more are joined by token.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path (host lower-cased). ``tokens``:
    runs of a-z and 0-9 that any match leaves whole. The matching rule of the
    greatest ``weight`` decides, then the least name. Without tokens it is
    tried on every URL."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    by_site: bool


def site_rule(action: str, rule: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix, as in ``example.com/en/7``; longer rules weigh more."""
    host, slash, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?![a-z0-9]|$)", path.lower())
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}" if slash else rf"^(?:[^/]*\.)?{re.escape(host.lower())}(?:/|$)"
    return Rule(rule, action, pattern, tuple(whole), len(rule), True)


def word_rule(action: str, *words: str) -> Rule:
    """A rule for URLs in which the words follow one another, set off by other characters."""
    name = "-".join(words)
    return Rule(name, action, "(?i)(?:^|[^a-z0-9])" + "[^a-z0-9]+".join(words) + "(?:[^a-z0-9]|$)", words, 0, False)


#: The site rules.
SITE_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
WORD_RULES = tuple(word_rule("block", *x.split()) for x in ("spam farm", "casino", "porn", "xxx", "viagra", "adserver", "clickbait", "malware", "phishing", "free money"))
RULES = SITE_RULES + WORD_RULES


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(site: Column) -> Column:
    """The URL's distinct runs of a-z and 0-9, A-Z lower-cased as the patterns take them: other letters set words apart."""
    return F.array_distinct(F.split(F.translate(site, _UPPER, _LOWER), "[^a-z0-9]+"))


def token_index(sites: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, counted over all URLs; rules without tokens under
    ``ALWAYS``. As many counts as rules have tokens reach the driver."""
    known = sorted({t for r in rules for t in r.tokens})
    counted = sites.select(F.explode(F.array_intersect(tokens(F.col("site")), F.array(*(F.lit(t) for t in known)).cast("array<string>"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    n = {r["t"]: r["n"] for r in counted.toLocalIterator()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (n.get(t, 0), t), default=ALWAYS), []).append(r)
    return index


_RULE = "struct<by_site:boolean,weight:int,name:string,action:string,pattern:string>"


def _literal(r: Rule) -> Column:
    return F.struct(F.lit(r.by_site).alias("by_site"), F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"))


def _best(matching: Column) -> Column:
    """Site rules before word rules, heavier before lighter, then the least name."""
    return F.array_min(F.transform(matching, _ranked))


def _ranked(r: Column) -> Column:
    """A rule such that the least decides."""
    return F.struct((~r["by_site"]).alias("by_word"), (-r["weight"]).alias("light"), r["name"].alias("name"), r["action"].alias("action"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rule`` is the site rule that decides, null where none fits; ``verdict``
    is its action, else that of a matching word rule, else ``default``. Null
    URLs and URLs without ``://`` have empty parts, which only a rule without
    tokens can fit. Of rules of one weight the least name decides. Very long
    URLs are judged whole. Repeated rows each come out; other columns are
    ignored, whatever their names; no rows give no rows.
    With up to ``inline`` rules the index travels in the plan and nothing is
    shuffled; more rules are joined to the distinct sites' tokens, broadcast while
    there are at most ``BROADCAST_ROWS``. Rules without tokens need no join."""
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("site", F.concat("host", "path"))
    index = token_index(rows, rules)
    if len(rules) <= inline:
        pairs = [x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_literal, rs)))]
        fetched = F.flatten(F.filter(F.transform(F.array_append(tokens(F.col("site")), F.lit(ALWAYS)), lambda t: F.create_map(*pairs)[t]), lambda x: x.isNotNull()))
        hits = F.filter(fetched, lambda r: F.rlike(F.col("site"), r["pattern"]))
        judged = rows.withColumn("best", _best(hits))
    else:
        always = F.array(*map(_literal, index.pop(ALWAYS, []))).cast(f"array<{_RULE}>")
        table = pages.sparkSession.createDataFrame([(t, (r.by_site, r.weight, r.name, r.action, r.pattern)) for t, rs in index.items() for r in rs], f"t string, r {_RULE}")
        table = F.broadcast(table) if len(rules) <= BROADCAST_ROWS else table
        sites = rows.select("site").distinct().select("site", F.explode(tokens(F.col("site"))).alias("t"))
        hits = sites.join(table, "t").where(F.rlike(F.col("site"), F.col("r.pattern")))
        best = hits.groupBy("site").agg(F.min(_ranked(F.col("r"))).alias("fetched"))
        tried = _best(F.filter(always, lambda r: F.rlike(F.col("site"), r["pattern"])))
        judged = rows.join(best, "site", "left").withColumn("best", F.least("fetched", tried))
    return judged.select("page_id", "host", "path", F.when(~F.col("best.by_word"), F.col("best.name")).alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle() -> str:
    """DuckDB SQL of ``judge`` over ``pages`` with ``RULES``, without an index."""
    fits = []
    for r in sorted(SITE_RULES, key=lambda r: -r.weight):
        host, _, path = r.name.partition("/")
        fits.append((f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}'))", r.name, r.action))
    rule = "case " + " ".join(f"when {c} then '{n}'" for c, n, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{a}'" for c, _, a in fits)
    words = " or ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in WORD_RULES)
    return f"""
      with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
      b as (select page_id, {_HOST} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a)
      select page_id, host, path, {rule} as rule, {verdict} when {words} then 'block' else 'allow' end as verdict from b"""
