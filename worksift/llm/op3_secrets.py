"""Secret scanning with an incremental blob ledger.

Every historical version is addressed by the SHA-256 of its content, so a blob that many paths or versions share is scanned
once. The ledger says which (blob, rule, rule version) were scanned and what was found; a run scans only pairs
that it lacks. Findings are joined back to every path and version that holds the blob. Only built-in functions are used: a
rule's places follow from the lengths of its matches and of the text between them.

Defined results: a null text is empty, a blob of its own without findings; repeated rows are reported each; null
paths are kept; extra columns are carried along, but for ``text``, which findings leave out, and ``found``, which they replace;
empty tables give no rows. Offsets count code points, ends are exclusive. A ledger's rows are unique by (blob, rule, version).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, fresh, let, spread_join

LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values. Of a run of hex digits or upper-case characters only the length matters, so it is part of the pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
_SPANS = "array<struct<start:int,end:int>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in ``text``, by place."""
    pattern = F.lit(rule.pattern)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else size
    gap = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))

    def walk(parts: Column, at: Column) -> Column:
        """Spans of a few ``parts`` that begin at ``at``."""

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + x["size"]
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(parts, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")), step, lambda s: s["spans"])

    def blocks(parts: Column) -> Column:
        """Blocks of about the root of the count, so that lists are appended to few times, however many matches a text has."""
        width = F.greatest(F.ceil(F.sqrt(F.size(parts))).cast("int"), F.lit(1))
        cutting = F.transform(F.sequence(F.lit(1), F.size(parts), width), lambda i: F.slice(parts, i, width))
        return let(cutting, placed)

    def placed(cutting: Column) -> Column:
        length = F.transform(cutting, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        starts = F.aggregate(length, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(cutting, F.slice(starts, F.lit(1), F.size(cutting)), walk))

    # The text after the last match has no size: as a null it ends the zip without a span.
    parts = F.filter(F.arrays_zip(gap.alias("gap"), size.alias("size"), value.alias("value")), lambda x: x["size"].isNotNull())
    return F.when(F.regexp(text, pattern), let(parts, blocks)).otherwise(F.array().cast(_SPANS))


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the (blob, text) rows: one for each blob and rule version that ``ledger`` lacks."""
    if ledger is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("rule_version").cast("string"))).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.where(F.size(F.array_except(F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules)), "done")) > 0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.array(*(F.when(~F.array_contains("done", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), spans_of(text, r).alias("spans"))) for r in rules))
    return todo.select("blob", F.explode(F.array_compact(found)).alias("x")).select("blob", "x.rule", "x.rule_version", "x.spans")


def distinct_blobs(history: DataFrame) -> DataFrame:
    """(blob, text) for each content in ``history``. Copies are dropped before the shuffle."""
    return history.select(blob_id(F.col("text")).alias("blob"), F.col("text").cast("string")).dropDuplicates(["blob"])


def update(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows to append after ``history`` (text, ...) was seen."""
    return scan(distinct_blobs(history), ledger, rules)


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``history`` without its text, with ``found``: array of (start, rank of the rule, kind, end) by place and rule.

    Only blobs with findings are joined back; the paths of a blob that a third of all rows hold are dealt to several tasks.
    """
    history = history.drop("found")
    blob, text = fresh(history, "blob")[0], F.col("text")
    wanted = F.create_map(*(F.lit(x) for r in rules for x in (f"{r.kind}@{r.version}", rules.index(r))))
    ranked = ledger.withColumn("rank", F.try_element_at(wanted, F.concat_ws("@", "rule", F.col("rule_version").cast("string")))).where("rank is not null and size(spans) > 0")
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.col("rank").alias("rank"), F.col("rule").alias("kind"), x["end"].alias("end")))
    of_blob = cut(ranked.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found")))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    paths = cut(history.withColumn(blob, blob_id(text)).drop("text"))
    found = spread_join(paths, of_blob, [blob], "left")
    return found.select(*(F.col(f"`{c}`") for c in history.columns if c != "text"), F.coalesce("found", none).alias("found"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``, seen as two versions of the corpus.

    The first version has half of the documents and is scanned with an older rule for hex digits. The second has all of them
    and the rules of today: what the ledger has of these contents isn't scanned again but for the newer rule.
    """
    history = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    older = tuple(Rule(r.kind, 0, "[0-9a-f]{32,}") if r.kind == "hex" else r for r in RULES)
    first = cut(update(history.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), None, older))
    ledger = first.unionByName(cut(update(history, first)))
    found = findings(history, ledger)
    written = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return found.select("doc_id", *counts, F.sha2(written, 256).alias("base_sha256"), written.alias("spans"))


def _oracle_kind(kind: str, rank: int) -> str:
    rule = next(r for r in RULES if r.kind == kind)
    pattern, value = rule.pattern.replace("'", "''"), f"len(v[i]) >= {rule.least}" if rule.group else "true"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS r, a AS s, a + len(m[i]) AS e FROM (
  SELECT *, unnest(range(1, len(m) + 1)) AS i, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS a
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS v, regexp_split_to_array(text, '{pattern}') AS g FROM t)) WHERE {value}"""


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_oracle_kind(r.kind, k) for k, r in enumerate(RULES))}),
j AS (SELECT doc_id, sum((kind = 'assign')::BIGINT)::BIGINT AS n_assign, sum((kind = 'access')::BIGINT)::BIGINT AS n_access, sum((kind = 'hex')::BIGINT)::BIGINT AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, r) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN j USING (doc_id)
"""
