"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and words in repeated three-word windows. The method then compares two
histograms of a document with those of its language by Jensen-Shannon distance: character classes, and the language's
``COMMON`` most frequent words with one bin for all others.

The language references come from a stated reference set: all documents that are labelled good and not held out. So a verdict doesn't change with the documents that are judged beside it. A short text is far from any reference by
chance, so what is too far is learnt by length, in each half octave of word counts: beyond all reference documents, and
``SPREAD`` standard deviations above their mean distance, by a ``MARGIN``. Texts below the minimum lengths aren't judged by a histogram. Only built-in functions are used.

Defined results: a null text has no words and fails the base rules; documents of a null language, or of one with fewer than
``MIN_DOCUMENTS`` references, are judged by the base rules alone; repeated rows are judged each; extra columns are ignored; an
empty table gives no rows; without labels only the base rules judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worksift.llm.common import cut, let, small, stored

#: Words of a language's list, and reference documents that a language or a band of lengths needs. Every language that has so many
#: gets a list.
COMMON, MIN_DOCUMENTS = 300, 30
CLASSES = ("lower", "upper", "digit", "space", "symbol", "wide", "rest")
MIN_WORDS, MAX_REPEATED = 50, 50
#: Least characters and words that a histogram judges.
MIN_CHARS, MIN_JUDGED_WORDS = 200, 64
SPREAD, MARGIN = 5.0, 1.03
_RUNS = "array<struct<h:bigint,n:int>>"
#: A mark holds a place below ``_PLACES`` and, in the bits of ``_PART``, part of a hash; never negative, so that differences are exact.
_PLACES = 1 << 31
_PART = (1 << 62) - _PLACES
#: Lists that a language's words are dealt to by hash, a power of two: a map is searched from its start, so none should be long.
LISTS = 128


def plain_words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space: split by a plain character, which is fast."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def window_marks(hashes: Column, width: int = 3) -> Column:
    """A number for each place of the words, given as hashes: part of its window's hash before the place; sorted, so like windows are neighbours."""
    window = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))
    return F.sort_array(F.transform(hashes, lambda _, i: window(i).bitwiseAND(F.lit(_PART)).bitwiseOR(i.cast("bigint"))))


def near_places(marks: Column) -> Column:
    """Places whose mark has a neighbour of the same part: all whose window occurs twice or more, and few others."""
    near = F.filter(marks, lambda x, i: (F.get(marks, i + 1) - x < _PLACES) | (x - F.get(marks, i - 1) < _PLACES))
    return F.transform(near, lambda x: x.bitwiseAND(F.lit(_PLACES - 1)).cast("int"))


def repeated_window_words(hashes: Column, near: Column, width: int = 3) -> Column:
    """How many words, given as hashes, lie in windows of ``width`` words that occur twice or more; sorts, never pairs.

    ``near`` are the places to look at, see ``near_places``; whole hashes of their windows are compared.
    """

    def twice(keys: Column) -> Column:
        n = F.size(keys)
        same = F.zip_with(F.slice(keys, 1, n - 1), F.slice(keys, 2, n - 1), lambda a, b: F.when(a["key"] == b["key"], F.array(a["at"], b["at"])))
        at = F.array_distinct(F.flatten(F.array_compact(same)))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(i + k for k in range(width)))))))

    whole = F.filter(near, lambda i: i <= F.size(hashes) - width)
    keys = F.transform(whole, lambda i: F.struct(F.xxhash64(*(F.get(hashes, i + k) for k in range(width))).alias("key"), i.alias("at")))
    found = let(F.sort_array(keys), lambda k: F.when(F.size(k) > 1, twice(k)).otherwise(0))
    return F.when(F.size(near) > 1, found).otherwise(0).cast("long")


def run_ends(hashes: Column) -> Column:
    """Where the runs of equal, sorted hashes end, counted from 1."""
    return F.array_compact(F.transform(hashes, lambda x, i: F.when(~F.get(hashes, i + 1).eqNullSafe(x), i + 1)))


def runs_of(hashes: Column, ends: Column) -> Column:
    """(h, n): how often each of the sorted hashes occurs, by its ``run_ends``."""
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))))
    runs = F.zip_with(ends, starts, lambda to, start: F.struct(F.get(hashes, to - 1).alias("h"), (to - start).alias("n")))
    return F.when(F.size(ends) > 0, runs).otherwise(F.array().cast(_RUNS))


def features(docs: DataFrame, listed: list[str]) -> DataFrame:
    """Base counts, character classes and runs of ``listed`` words of each document, without its text.

    Arrays are sorted as columns of their own, where Spark sorts plain numbers, and not within a lambda.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    base = base.withColumn("words", plain_words(F.col("text")))
    lines = let(F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    common = F.transform(F.filter("words", lambda w: F.lower(w).isin(listed)), lambda w: F.xxhash64(F.lower(w))) if listed else F.array().cast("array<bigint>")
    found = base.select(
        "doc_id", "lang",
        F.length("text").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.array_join("words", "").alias("joined"),
        lines.cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.sort_array(common).alias("common"),
    )
    found = found.withColumns({"marks": window_marks(F.col("hashes")), "ends": run_ends(F.col("common"))})
    found = found.withColumns({"near": near_places(F.col("marks")), "runs": runs_of(F.col("common"), F.col("ends"))}).drop("marks", "common", "ends")
    found = found.withColumn("n_repeat_words", repeated_window_words(F.col("hashes"), F.col("near"))).drop("hashes", "near")
    # Each class is taken out of what the ones before it left. White space is out already; other alphabets go first, because they may
    # be the whole text, and a text whose bytes are as many as its characters has none.
    joined = F.col("joined")
    found = found.withColumn("left0", F.when(F.octet_length(joined) > F.length(joined), F.regexp_replace(joined, r"[^\x00-\x7F]+", "")).otherwise(joined))
    for k, pattern in enumerate(("[a-z]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+"), 1):
        found = found.withColumn(f"left{k}", F.regexp_replace(f"left{k - 1}", pattern, ""))
    left = [F.length(f"left{k}") for k in range(5)]
    lower, upper, digit, symbol = (a - b for a, b in zip(left, left[1:], strict=False))
    sizes = {"lower": lower, "upper": upper, "digit": digit, "space": F.col("n_chars") - F.length(joined), "symbol": symbol, "wide": F.length(joined) - left[0], "rest": left[4]}
    classes = F.array(*(sizes[c].cast("double") for c in CLASSES))
    return found.select("doc_id", "lang", "n_words", F.length(joined).cast("long").alias("word_chars"), symbol.cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words", classes.alias("classes"), "runs")


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count vectors; null if one of them is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def whole(x: Column) -> Column:
        sums = x["sums"]
        return F.aggregate(F.zip_with(x["a"], x["b"], lambda p, q: F.struct((p / F.nullif(sums["a"], F.lit(0.0))).alias("p"), (q / F.nullif(sums["b"], F.lit(0.0))).alias("q"))), F.lit(0.0), lambda s, v: s + (term(v["p"], (v["p"] + v["q"]) / 2) + term(v["q"], (v["p"] + v["q"]) / 2)) / 2)

    divergence = let(F.struct(a.alias("a"), b.alias("b"), F.struct(total(a).alias("a"), total(b).alias("b")).alias("sums")), whole)
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _list_of(h: Column) -> Column:
    return h.bitwiseAND(F.lit(LISTS - 1)).cast("int")


def dealt_shares(shares: DataFrame) -> DataFrame:
    """(lang, shares, rest): of each language ``LISTS`` maps of hash to share, each with the hashes that are dealt to it, or null."""
    rows = shares.select("lang", "share", "rest", F.xxhash64("word").alias("h"))
    maps = rows.groupBy("lang", _list_of(F.col("h")).alias("at")).agg(F.map_from_entries(F.collect_list(F.struct("h", "share"))).alias("map"), F.max("rest").alias("rest"))
    told = maps.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("at", "map"))).alias("maps"), F.max("rest").alias("rest"))
    return told.select("lang", F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda k: F.try_element_at("maps", k)).alias("shares"), "rest")


def word_distance(runs: Column, total: Column, shares: Column, rest: Column) -> Column:
    """Jensen-Shannon distance of a document's common words from its language's ``shares`` (``rest`` for others), see ``dealt_shares``.

    Words that the document lacks add what their shares leave: they needn't be visited.
    """

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    def step(state: Column, x: Column) -> Column:
        added = F.struct((state["sum"] + term(x["n"] / total, x["q"])).alias("sum"), (state["seen"] + x["q"]).alias("seen"), (state["n"] + x["n"]).alias("n"))
        return F.when(x["q"].isNull(), state).otherwise(added)

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("seen"), F.lit(0).alias("n"))
    with_share = F.transform(runs, lambda x: F.struct(x["n"].alias("n"), F.try_element_at(F.get(shares, _list_of(x["h"])), x["h"]).alias("q")))
    whole = F.aggregate(with_share, start, step, lambda s: s["sum"] + (1 - rest - s["seen"]) + term(1 - s["n"] / total, rest))
    return F.sqrt(F.greatest(whole, F.lit(0.0)) / 2)


def reference_rows(labels: DataFrame) -> DataFrame:
    """(doc_id) of the reference set: all that are labelled good and not held out; broadcast only if they fit."""
    kept = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    return small(cut(labels.where("quality = 1").select(F.col("doc_id").cast("long")).where(kept).distinct()))


def word_shares(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(lang, word, share, rest): the most frequent words of each language of the reference set."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string")).where("lang is not null").join(good, "doc_id")
    rows = stored(rows.select("lang", F.transform(plain_words(F.coalesce("text", F.lit(""))), F.lower).alias("words")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("words")).alias("total")).where(F.col("docs") >= MIN_DOCUMENTS)
    counts = rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count().join(F.broadcast(sizes), "lang")
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("r") <= COMMON)
    top = top.withColumn("share", F.col("count") / F.col("total"))
    return cut(top.select("lang", "word", "share", (1 - F.sum("share").over(Window.partitionBy("lang"))).alias("rest")))


def limits(judged: DataFrame) -> DataFrame:
    """(lang, band, most_class, most_word): what is too far, from the reference documents' distances by band of length.

    A band with few documents takes the limits of the next shorter one that has enough, else of the next longer one.
    """

    def learnt(c: str) -> Column:
        return F.when(F.count(c) >= MIN_DOCUMENTS, F.greatest(F.avg(c) + SPREAD * F.stddev_pop(c), F.max(c)))

    found = judged.groupBy("lang", "band").agg(learnt("class_distance").alias("most_class"), learnt("word_distance").alias("most_word"))
    grid = judged.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(130))).alias("band"))  # bounded
    before = Window.partitionBy("lang").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("lang").orderBy("band").rowsBetween(0, Window.unboundedFollowing)
    near = {c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) for c in ("most_class", "most_word")}
    grid = grid.join(found, ["lang", "band"], "left").withColumns(near)
    # What moves the classes, such as a long number, is as likely in any language.
    most = {"most_class": F.max("most_class").over(Window.partitionBy("band")), "most_word": F.col("most_word")}
    return grid.withColumns({c: MARGIN * v for c, v in most.items()})


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, distances and the verdict for each document."""
    good = reference_rows(labels)
    shares = word_shares(docs, good)
    listed = sorted(r["word"] for r in shares.select("word").distinct().collect())  # at most COMMON words a language
    found = stored(features(docs, listed))
    sums = found.join(good, "doc_id").groupBy("lang").agg(*(F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))))
    told = cut(dealt_shares(shares).join(sums, "lang", "left").select("lang", "shares", "rest", F.array(*(f"c{k}" for k in range(len(CLASSES)))).alias("ref_classes")))
    chars = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x)

    def measured(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(told), "lang", "left")  # a row a language
        return rows.select(
            "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.floor(2 * F.log2(F.greatest("n_words", F.lit(1)))).cast("int").alias("band"),
            F.when(chars >= MIN_CHARS, F.round(js_distance(F.col("classes"), F.col("ref_classes")), 6)).alias("class_distance"),
            F.when((F.col("n_words") >= MIN_JUDGED_WORDS) & F.col("shares").isNotNull(), F.round(word_distance(F.col("runs"), F.col("n_words"), F.col("shares"), F.col("rest")), 6)).alias("word_distance"),
        )

    most = cut(limits(measured(found.join(good, "doc_id", "left_semi").join(F.broadcast(told.select("lang")), "lang", "left_semi"))))
    judged = measured(found).join(F.broadcast(most), ["lang", "band"], "left")  # at most 131 rows a language
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > F.col("most_class"), F.lit(False)) | F.coalesce(F.col("word_distance") > F.col("most_word"), F.lit(False))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far).drop("band", "most_class", "most_word")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts for all ``documents``."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("lang")
