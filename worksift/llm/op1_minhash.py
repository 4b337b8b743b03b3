"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set holds the distinct hashes of its five-word shingles (words: lower-cased runs of anything but ASCII
white space; with fewer words the whole sequence is one shingle). Documents with equal sets form a class at once, so
copies are never paired. One permutation deals a set's hashes to ``BINS`` bins and keeps the least of each; an empty
bin borrows from the first filled bin of a random order of its own. ``ROWS`` bins make a band, each band names a bucket. A
bucket of m classes gives m - 1 candidate edges, all to its centre, the member that meets most others: the count of pairs
is linear.

Edges are confirmed on full sets: each class's edge with the most shared buckets. What is left, the members of buckets that
still span components, meets by its rarest shingles (prefix filtering with bounds on place and size), which leaves out no pair
that is similar enough; these pairs are confirmed too. So every link between two classes that share a bucket is found.
A hot bucket, class or centre is split, and what documents merely share with many others makes no pairs.

Defined results: null or blank text has an empty set and links with nothing. Repeated rows are copies. Rows that share a
doc_id but not their text each have the component of their own text; groups that the same smallest doc_id names are one.
A null doc_id takes no part, its component is null and it is kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import components, cut, spread_join, small

SHINGLE, BINS, ROWS = 5, 160, 4
#: A link needs DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Edges of one centre that one task confirms, about.
FAN = 256
#: Slots of the histogram of shingles; a power of two.
SLOTS = 1 << 18
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(SHINGLE, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _MUL + hashed[k : n - width + 1 + k]
        out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    out.sort()
    return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def probe_orders(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others when it is empty: independent random permutations."""
    rng = np.random.default_rng(20240229)
    return np.argsort(rng.random((bins, bins)), axis=1)


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Least hash of each bin, with empty bins densified. ``hashes`` is sorted and not empty."""
    bins = len(orders)
    at = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at[first].astype(np.intp)] = hashes[first]
    filled[at[first].astype(np.intp)] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = orders[empty]
        out[empty] = out[asked[np.arange(len(empty)), filled[asked].argmax(axis=1)]]
    return out


def bands(sign: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    grid = sign.reshape(-1, rows)
    key = np.arange(1, len(grid) + 1, dtype=np.uint64) * _MIX
    for k in range(rows):
        key = (key ^ grid[:, k]) * _MUL
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch(docs: DataFrame, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, class, bands) for each row; ``class`` is a 128-bit digest of the set, null if it is empty."""
    orders = probe_orders(bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, classes, keys = [], [], []
            for text in batch["text"]:
                found = shingle_set(text)
                sizes.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(bands(signature(found, orders), rows) if len(found) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "class": classes, "bands": keys})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n_shingles long, class binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, class, shingles) with whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "class": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "shingles": [x.view(np.int64) for x in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, class binary, shingles array<long>")


def confirm(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) whose full sets are similar enough. A hot ``a``, such as a star's centre, is dealt to many tasks."""
    fans = edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > FAN).select("a", F.ceil(F.col("n") / FAN).cast("int").alias("fan"))
    fans = small(cut(fans))  # at most one row for each FAN edges
    edges = edges.join(fans, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("fan", F.lit(1))).alias("salt"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).join(fans, "a", "left")
    left = left.select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("fan", F.lit(1)).cast("long") - 1)).alias("salt"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = edges.join(right, "b").join(left, ["a", "salt"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.where(DENOMINATOR * F.col("common") >= NUMERATOR * union).select("a", "b").distinct()


def _ceil(part, whole):
    return -(-part // whole)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, in ``SLOTS`` slots of their hashes: of bounded size whatever the corpus. Hot ones stand out in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for found in batch["shingles"]:
                np.add.at(total, found.view(np.uint64) & np.uint64(SLOTS - 1), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = sets.select("shingles").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["at"].to_numpy(int)] = rows["n"].to_numpy()
    return out


def rare_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``sets`` (doc_id, root, shingles) with different roots that may be similar enough; exact, none is left out.

    Shingles are ordered from rare to frequent. Similar sets share one of the first in that order: the larger set's first
    quarter meets the smaller one's first seventh, for a similarity of 0.75. So what many documents share, such as
    a common passage, is not what they meet by. A shingle with m documents of its most frequent root and k others makes (m + k) * k pairs at
    most, and its documents are dealt to many tasks if there are many.
    """
    sent = sets.sparkSession.sparkContext.broadcast(frequencies(sets))
    both, over = NUMERATOR + DENOMINATOR, 2 * NUMERATOR

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["shingles"].str.len().to_numpy(np.int64)
            first = sizes - _ceil(NUMERATOR * sizes, DENOMINATOR) + 1
            kept = []
            for found, n in zip(batch["shingles"], first, strict=True):
                slots = (found.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.intp)
                kept.append(found[np.lexsort((found, sent.value[slots]))[:n]])
            row = np.repeat(np.arange(len(batch)), first)
            at = np.arange(len(row)) - np.repeat(first.cumsum() - first, first)
            early = at < (sizes - _ceil(over * sizes, both) + 1)[row]
            yield pd.DataFrame({"token": np.concatenate([*kept, np.empty(0, np.int64)]), "doc_id": batch["doc_id"].to_numpy()[row], "root": batch["root"].to_numpy()[row], "n": sizes[row], "at": at, "early": early})

    tokens = sets.mapInPandas(run, "token long, doc_id long, root long, n long, at long, early boolean")
    tokens = cut(tokens)
    # Members of a token's most frequent root meet only those of other roots: a family of copies makes no pairs within itself.
    held = tokens.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots"))
    held = held.where("roots > 1").select("token", F.col("top.root").alias("main"))
    tokens = cut(tokens.join(held, "token").withColumn("main", F.col("root") == F.col("main")))

    def side(of: str, rows: DataFrame) -> DataFrame:
        return rows.select("token", *(F.col(c).alias(f"{c}_{of}") for c in ("doc_id", "root", "n", "at", "early")))

    others, family = tokens.where("not main"), tokens.where("main and early")
    # The side that may hold a third of all rows is dealt to several tasks.
    met = spread_join(side("y", tokens), side("x", others.where("early")), ["token"]).unionByName(spread_join(side("x", family), side("y", others), ["token"]))
    met = met.where("root_x <> root_y and (n_x < n_y or n_x = n_y and (doc_id_x < doc_id_y or early_y and doc_id_x <> doc_id_y))")
    # What follows the first shared shingle bounds what two sets have in common.
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = met.where((DENOMINATOR * F.col("n_x") >= NUMERATOR * F.col("n_y")) & (both * left >= NUMERATOR * (F.col("n_x") + F.col("n_y"))))
    return met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each document."""
    sketched = cut(sketch(docs, bins, rows))
    valid = sketched.where("doc_id is not null and class is not null")
    classes = valid.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")  # of two classes or more
    shared = cut(members.join(buckets, "bucket"))

    # A bucket's centre is the member that meets most others: the original of a family of copies.
    weights = shared.groupBy("rep").agg(F.sum("m").alias("weight"))
    centres = cut(shared.join(weights, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("c"), F.count("*").alias("m")).select("bucket", "m", (-F.col("c.minus")).alias("centre")))
    stars = spread_join(shared.select("bucket", "rep"), centres, ["bucket"], weight="m").where("rep <> centre").groupBy("centre", "rep").agg(F.count("*").alias("n"))
    best = stars.groupBy("rep").agg(F.max(F.struct("n", (-F.col("centre")).alias("minus"))).alias("top"))
    best = cut(best.select((-F.col("top.minus")).alias("a"), F.col("rep").alias("b")))

    wanted = cut(shared.select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    sets = cut(full_sets(texts))
    if sets.count() > wanted.count():  # rows that share an id
        sets = cut(sets.dropDuplicates(["doc_id", "class"]))
    linked = cut(confirm(best, sets))
    roots = components(linked)
    rooted = cut(wanted.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("root")))

    named = shared.select("bucket", F.col("rep").alias("doc_id")).join(rooted, "doc_id")
    spans = cut(named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high").select("bucket", "m"))
    left = spread_join(named, spans, ["bucket"], weight="m").select("doc_id", "root").distinct()
    pairs = cut(rare_pairs(sets.join(left, "doc_id").select("doc_id", "root", "shingles")))
    further = confirm(pairs, sets)
    ends = rooted.select(F.col("doc_id").alias("a"), F.col("root").alias("ra")), rooted.select(F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    merged = components(further.join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    final = rooted.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(F.col("doc_id").alias("rep"), F.coalesce("to", "root").alias("root"))

    of_class = cut(classes.select("class", "rep", "n").join(final, "rep", "left").select("class", "n", F.coalesce("root", "rep").alias("root")))
    out = spread_join(sketched.select("doc_id", "n_shingles", "class"), of_class, ["class"], "left", "n")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, over all of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact links by brute force over shared shingles, then components by the smallest reachable id.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
  UNION SELECT b, a FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.a, r.root FROM l JOIN r ON l.b = r.doc_id WHERE r.root < l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
