"""Secret scanning over an incremental blob ledger, with DataFrame functions only.

Every version of a document is a blob named by its content. The ledger, a
Parquet folder, records which rule versions a blob was scanned with and what
they found. A scan takes one row of each blob that some rule version has not
seen, runs only the unseen rules, appends to the ledger, and joins findings
back to all paths of a blob. A changed rule gets a new version, and only that
one is run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.llm.common import new_table_path, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is found leftmost, non-overlapping; a match stands if its
    ``group`` has ``least`` characters. ``hints``: one of these literals, in
    lower case, is in every text with a match; without hints all texts are searched."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules. A run of hex digits, or of key characters, that is
#: too short stays so at every later start, so their least lengths are part of the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 24, ("xox",)),
    # Only whole runs can start it, so a long run without dots is read once.
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 30, ("eyj",)),
    Rule("cloud_key", 1, r"AIza[A-Za-z0-9_-]{35}", 0, 39, ("aiza",)),
    Rule("login_url", 1, r"[a-z][a-z0-9+]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{3,128})@", 1, 3, ("://",)),
)
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<rule:string,kind:string,start:bigint,end:bigint>>"


def _spans(rule: Rule) -> Column:
    """Spans of one rule in ``text``: matches and the gaps between them come in
    one order, so positions are running lengths of both."""
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    walk = f"""
      aggregate(
        sequence(0, size(found) - 1),
        named_struct('at', 0L, 'out', cast(array() as {_SPANS})),
        (acc, i) -> named_struct(
          'at', acc.at + length(gaps[i]) + length(found[i]),
          'out', if(length(kept[i]) >= {rule.least},
            array_append(acc.out, named_struct('rule', '{rule.key}', 'kind', '{rule.kind}',
              'start', acc.at + length(gaps[i]), 'end', acc.at + length(gaps[i]) + length(found[i]))),
            acc.out)),
        acc -> acc.out)"""
    for name, part in (("found", f"regexp_extract_all(text, '{p}', 0)"), ("kept", f"regexp_extract_all(text, '{p}', {rule.group})"), ("gaps", f"split(text, '{p}', -1)")):
        walk = f"element_at(transform(array({part}), {name} -> {walk}), 1)"
    return F.expr(f"case when array_contains(todo, '{rule.key}') and {_hit(rule)} then {walk} else cast(array() as {_SPANS}) end")


def _hit(rule: Rule) -> str:
    """Whether ``text``, in lower case ``low``, holds a match of the rule's pattern."""
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    may = " or ".join(f"contains(low, '{h}')" for h in rule.hints) or "true"
    return f"(({may}) and text rlike '{p}')"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rules, findings) of all earlier scans; empty if there were none."""
    schema = f"blob binary, rules array<string>, findings {_SPANS}"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger hasn't seen; returns (doc_id, blob, findings) of
    every row of ``versions``, findings as of the current ``rules``.

    Null texts are the empty blob; very long texts are scanned whole; null ids
    stay null. Repeated rows share a blob and each come out; of several rows
    with a blob's least id each is scanned and their equal findings are one.
    Other columns are ignored, whatever their names; no rows give no rows. A text that no rule's
    pattern finds anything in stays where it is read: its blob is entered without findings. The
    others move once, keyed by blob and id, so a blob with many copies is
    spread; only its row with the least id is scanned."""
    spark = versions.sparkSession
    rows = versions.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blob = F.unhex(F.sha2("text", 256)).alias("blob")
    names = written(rows.select("doc_id", blob), "versions")
    current = F.array(*(F.lit(r.key) for r in rules))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = written(
        names.groupBy("blob").agg(F.min("doc_id").alias("first_id")).join(seen, "blob", "left")
        .withColumn("todo", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select(F.col("blob").alias("b"), "first_id", "todo"),
        "unseen",
    )
    hit = F.expr(" or ".join(map(_hit, rules)) or "false")
    moved = rows.withColumn("low", F.lower("text")).where(hit).select("doc_id", blob, "text")
    # Hashed, not sorted: the side with texts streams past the small one.
    unseen = moved.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("blob", "todo", "text", F.lower("text").alias("low"))
    found = unseen.select("blob", F.flatten(F.array(*(_spans(r) for r in rules))).alias("findings"))
    scanned = todo.join(found, F.col("b") == F.col("blob"), "left").select(F.col("b").alias("blob"), F.col("todo").alias("rules"), F.coalesce("findings", F.array().cast(_SPANS)).alias("findings"))
    scanned.write.mode("append").parquet(ledger)
    now = F.filter(F.array_distinct(F.flatten(F.collect_list("findings"))), lambda x: F.array_contains(current, x["rule"]))
    findings = read_ledger(spark, ledger).where(F.size("findings") > 0).groupBy("blob").agg(now.alias("findings"))
    return names.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(_SPANS)).alias("findings"))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from :func:`scan`'s rows."""
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    base = F.array(*(F.lit(r.kind) for r in BASE_RULES))
    ranked = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("order"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.withColumn("ranked", ranked).select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(spelled(F.filter("ranked", lambda x: F.array_contains(base, x["kind"]))), 256).alias("base_sha256"),
        spelled("ranked").alias("spans"),
    )


def find(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`scan` and :func:`report`; a new ledger in the shared folder where none is named.

    An empty table gives an empty result; other columns are ignored."""
    return report(scan(docs, ledger or new_table_path(docs.sparkSession, "secret-ledger"), rules, id_col, text_col), rules)
