"""Near-duplicate line removal by a deletion-neighbourhood join.

Lines are compared as lower-cased words, and an edit inserts, deletes or substitutes one word; the bound is one edit. Two lines
within it agree after at most one deletion in each, so every line emits its variants as hashed keys: itself, and itself without
word i for each i. Substitutions meet under (words left, i, hash), one inserted word meets under (words left, hash). Only
the earliest line of a key can be a reason to drop the others, so equal variants meet in aggregates, not in pairs, and a
key that a third of all lines share costs one row for each task. Each line and its earliest partner are then
compared word by word.

A line is dropped if an earlier line, by (doc_id, place), is within the bound. Lines without a word are never dropped. Of lines
with fewer than ``MIN_WORDS`` words only copies are: there one word is too much of the meaning. Exact copies are resolved
first by a 128-bit hash. Variants are emitted only for lines that share their first or last half with a different line: of two
lines within one edit, one half is untouched. Words are hashed once; sums of their hashes make each variant's key from its
neighbour's in one step, so very long lines stay linear. Only built-in functions are used.

Defined results: a null text stays null, an empty one empty; rows that share doc_id and text are one document and lose the
same lines; a null doc_id counts as the smallest; extra columns are carried along, but for ``dropped_lines``, which is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worksift.llm.common import cut, fresh, let, small, spread_join, stored

MIN_WORDS = 8
ORD = ["doc", "row", "line"]


def _key(docs: DataFrame) -> dict[str, Column]:
    """The document's key: ``doc``, and ``row`` to tell apart texts that share a doc_id."""
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "row": F.xxhash64(F.col("text").cast("string"))}


def _lines(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, row, line, words, n, k1, k2) of the lines with words; only of the ``wanted`` ones (doc, row, wanted) if given.

    ``words`` are hashes. Rare white space becomes a blank first, so that most lines are split by a plain character.
    """
    text, space = F.lower(F.col("text").cast("string")), r"[\x09\x0B-\x0D]"
    text = let(text, lambda x: F.when(x.rlike(space), F.regexp_replace(x, space, " ")).otherwise(x))
    rows = docs.select(*(c.alias(n) for n, c in _key(docs).items()), F.split(text, "\n", -1).alias("lines"))
    if wanted is None:
        lines = rows.select("doc", "row", F.posexplode("lines").alias("line", "words"))
    else:
        lines = rows.join(wanted, ["doc", "row"]).select("doc", "row", "lines", F.explode("wanted").alias("line")).withColumn("words", F.get("lines", F.col("line"))).drop("lines")
    lines = lines.withColumn("words", F.transform(F.array_remove(F.split("words", " ", -1), ""), lambda w: F.xxhash64(w)))
    lines = lines.withColumn("n", F.size("words")).where("n > 0")
    return lines.withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit("second"), "words")})


def _halves() -> Column:
    """Keys of the first and last halves that a line within one edit may share, each with its side."""
    n, words = F.col("n"), F.col("words")

    def key(first: bool, h: Column) -> Column:
        part = F.slice(words, F.lit(1) if first else n - h + 1, h)
        return F.struct(F.lit(first).alias("first"), F.xxhash64(F.lit(first), h, part).alias("half"))

    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    return F.array_compact(F.array(key(True, low), key(False, low), *(F.when(high > low, key(side, high)) for side in (True, False))))


def _hash(word: Column, place: Column, seed: int) -> Column:
    """38 bits, so that the sum over a line doesn't overflow."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), word, place.cast("int")), 26)


def _variants(lines: DataFrame) -> DataFrame:
    """(k1, k2, ord, base, size, at, t1, t2): the keys of each line, ``at`` -1 for inserted words."""

    def total(shift: int, seed: int) -> Column:
        return F.aggregate(F.transform("words", lambda w, i: _hash(w, i - shift, seed)), F.lit(0).cast("long"), lambda a, x: a + x)

    whole = lines.select("k1", "k2", "ord", F.lit(True).alias("base"), F.col("n").alias("size"), F.lit(-1).alias("at"), total(0, 1).alias("t1"), total(0, 2).alias("t2"))
    # The sums stand below the generator: beside it they would be taken anew for every word.
    words = lines.withColumns({"s1": total(1, 1), "s2": total(1, 2)})
    words = words.select("k1", "k2", "ord", "n", "by_first", "by_last", "s1", "s2", F.posexplode("words").alias("at", "word"))
    before = Window.partitionBy("k1", "k2").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k1", "k2").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    for seed in (1, 2):
        kept = F.coalesce(F.sum(_hash(F.col("word"), F.col("at"), seed)).over(before), F.lit(0))
        moved = F.col(f"s{seed}") - F.sum(_hash(F.col("word"), F.col("at") - 1, seed)).over(upto)
        words = words.withColumn(f"t{seed}", kept + moved)
    half = F.floor(F.col("n") / 2)
    words = words.where((F.col("by_first") & (F.col("at") >= half)) | (F.col("by_last") & (F.col("at") < F.col("n") - half)))
    words = words.withColumn("at", F.explode(F.array("at", F.lit(-1))))
    return whole.unionByName(words.select("k1", "k2", "ord", F.lit(False).alias("base"), (F.col("n") - 1).alias("size"), "at", "t1", "t2"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one inserted, deleted or substituted word."""

    def longer(x: Column, y: Column) -> Column:  # y is x and one word more
        n = F.size(x)
        place = F.array_position(F.zip_with(x, F.slice(y, F.lit(1), n), lambda p, q: p != q), True)
        at = F.when(place == 0, n + 1).otherwise(place.cast("int"))
        return F.concat(F.slice(y, F.lit(1), at - 1), F.slice(y, at + 1, n)) == x

    gap = F.size(a) - F.size(b)
    same = F.size(F.filter(F.zip_with(a, b, lambda p, q: p != q), lambda x: x)) <= 1
    return F.when(gap == 0, same).when(gap == 1, longer(b, a)).when(gap == -1, longer(a, b)).otherwise(False)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, row, dropped): numbers of the lines, from 0, that repeat an earlier line."""
    ord_ = F.struct(*ORD)
    halves = F.when(F.col("n") >= min_words, _halves()["half"]).otherwise(F.array().cast("array<bigint>"))
    seen = stored(_lines(docs).select(*ORD, "k1", "k2", halves.alias("halves")))

    halves = seen.select("k1", F.explode("halves").alias("half")).groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b"))
    shared = small(cut(halves.where("a <> b").select("half")))
    wanted = seen.select(*ORD, F.explode("halves").alias("half")).join(shared, "half").groupBy("doc", "row").agg(F.collect_set("line").alias("wanted"))
    wanted = small(cut(wanted), array="wanted")
    live = _lines(docs, wanted).select(*ORD, "k1", "k2", "n", "words", F.explode(_halves()).alias("x")).select("*", "x.first", "x.half").join(shared, "half")
    live = live.groupBy("k1", "k2").agg(F.min(ord_).alias("ord"), F.first("n").alias("n"), F.first("words").alias("words"), F.max("first").alias("by_first"), F.max(~F.col("first")).alias("by_last"))
    live = cut(live)

    keys = ["size", "at", "t1", "t2"]
    variants = _variants(live)
    met = variants.groupBy(*keys).agg(F.min(F.when(F.col("base"), F.col("ord"))).alias("whole"), F.min(F.when(~F.col("base"), F.col("ord"))).alias("less"), F.count("*").alias("m")).where("m > 1")
    met = small(cut(met), 120)
    partner = F.when((F.col("at") >= 0) | F.col("base"), F.col("less")).otherwise(F.col("whole"))
    pairs = variants.join(met, keys).withColumn("partner", partner).where("partner < ord").select("k1", "k2", "partner").distinct()
    texts = live.select("k1", "k2", "ord", "words")
    near = spread_join(cut(pairs), texts.select(F.col("ord").alias("partner"), F.col("words").alias("other")), ["partner"])
    near = near.join(texts.select("k1", "k2", "words"), ["k1", "k2"]).where(within_one_edit(F.col("words"), F.col("other"))).select("k1", "k2").distinct()

    copies = seen.groupBy("k1", "k2").agg(F.min(ord_).alias("first"), F.count("*").alias("m")).where("m > 1")
    reasons = copies.join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "full").select("k1", "k2", F.coalesce("near", F.lit(False)).alias("near"), "first", F.coalesce("m", F.lit(1)).alias("m"))
    dropped = spread_join(seen.select(*ORD, "k1", "k2"), cut(reasons), ["k1", "k2"], weight="m").where(F.col("near") | (ord_ != F.col("first")))
    return dropped.groupBy("doc", "row").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``dropped_lines``."""
    docs = docs.drop("dropped_lines")
    doc, row, dropped = fresh(docs, "doc", "row", "dropped")
    found = repeats(docs, min_words).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("dropped").alias(dropped))
    key = _key(docs)
    joined = docs.withColumns({doc: key["doc"], row: key["row"]}).join(found, [doc, row], "left")

    def rest(lines: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")

    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), rest))
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.coalesce(dropped, F.array().cast("array<int>")).alias("dropped_lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line removal leaves of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = drop_repeated_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join("dropped_lines", ",").alias("dropped_lines"), F.length(text).cast("long").alias("clean_chars"), F.sha2(text, 256).alias("clean_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
o AS (
  SELECT doc_id, i, list_filter(regexp_split_to_array(lower(ls[i + 1]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM t)),
c AS MATERIALIZED (SELECT doc_id, i, ws FROM o WHERE len(ws) >= 1),
f AS MATERIALIZED (SELECT ws, min((doc_id, i)) AS at, row_number() OVER (ORDER BY min((doc_id, i))) AS r FROM c GROUP BY ws),
v AS MATERIALIZED (SELECT r, k, len(ws) AS n, list_concat(ws[1:k - 1], ws[k + 1:]) AS x FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS k FROM f WHERE len(ws) >= 8)),
drop_near AS (
  SELECT b.r FROM v a JOIN v b ON a.x = b.x AND a.k = b.k AND a.r < b.r
  UNION SELECT greatest(a.r, f.r) FROM v a JOIN f ON a.x = f.ws WHERE len(f.ws) >= 8),
d AS (
  SELECT c.doc_id, c.i FROM c JOIN f USING (ws) WHERE (c.doc_id, c.i) <> f.at OR f.r IN (SELECT r FROM drop_near)),
g AS (SELECT doc_id, list(i::INT ORDER BY i) AS dropped FROM d GROUP BY doc_id),
e AS (SELECT t.doc_id, coalesce(g.dropped, []::INT[]) AS dropped,
  array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(coalesce(g.dropped, []::INT[]), i::INT)), lambda i: ls[i + 1]), chr(10)) AS clean
  FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, len(dropped)::BIGINT AS n_dropped, array_to_string(dropped, ',') AS dropped_lines, length(coalesce(clean, ''))::BIGINT AS clean_chars, sha256(coalesce(clean, '')) AS clean_sha256 FROM e
"""
