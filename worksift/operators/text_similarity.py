"""Cosine similarity join of short texts: TF-IDF vectors, weighted prefix filter, exact verification.

The words of a text are sorted by rarity, then by name. Its prefix is the words up to where what follows has a norm below the least
similarity. Two similar texts share a word, and their first common word lies in both prefixes: everything before it adds nothing, and
everything from it on must reach the least similarity. So texts of a block meet by equal words of their prefixes alone, and only if the
product of the weights, plus the product of the norms of what follows, still reaches it. The pairs that remain are
verified over all their words. No pair is missed, and frequent words, which stand last, make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksift.plans.lineage import cut, small


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def weigh(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, w, tail, after): unit TF-IDF weights of each different word of (key, text), a row for each text.

    ``tail`` is the norm of the word and those after it, rarest first, ``after`` the norm of those after it. The inverse document
    frequency is ln((1 + n) / (1 + df)) + 1, over all texts.
    """
    counts = cut(texts.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf")))
    n = texts.count()
    held = counts.groupBy("word").agg(F.count("*").alias("df"))
    held = small(cut(held.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)))
    raw = counts.join(held, "word").withColumn("w", F.col("tf") * F.col("idf"))
    whole = Window.partitionBy(key)
    rarest = whole.orderBy("df", "word")
    square = F.col("w") * F.col("w")
    rows = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(square).over(whole)))
    onward = rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = rarest.rowsBetween(1, Window.unboundedFollowing)
    return rows.select(key, "word", "w", F.sqrt(F.sum(square).over(onward)).alias("tail"), F.sqrt(F.coalesce(F.sum(square).over(later), F.lit(0.0))).alias("after"))


def similar_texts(rows: DataFrame, block: list[str], text: str, least: float = 0.86) -> DataFrame:
    """(text_a, text_b, similarity), text_a < text_b: different texts that share a block, with a cosine of at least ``least``.

    Similarities are rounded to four places, as the classes expect them. A text in several blocks is weighed and verified once. Null
    texts, texts without a word and rows with a null in ``block`` meet nothing.
    """
    distinct = cut(rows.where(F.col(text).isNotNull()).groupBy(*block, F.col(text).alias("text")).agg(F.lit(1).alias("_one")).drop("_one"))
    texts = cut(distinct.select(F.md5("text").alias("key"), "text").distinct())
    weighed = cut(weigh(texts, "key", "text"))
    bound = least - 1e-4  # rounding may lift a similarity by half of that
    prefix = weighed.where(F.col("tail") >= bound).select("key", "word", "w", "after")
    placed = cut(distinct.select(*block, F.md5("text").alias("key")).join(prefix, "key"))
    ends = [placed.select(*block, "word", F.col("key").alias(f"key_{e}"), F.col("w").alias(f"w_{e}"), F.col("after").alias(f"after_{e}")) for e in "ab"]
    reach = F.col("w_a") * F.col("w_b") + F.col("after_a") * F.col("after_b") >= bound
    met = cut(ends[0].join(ends[1], [*block, "word"]).where((F.col("key_a") < F.col("key_b")) & reach).select("key_a", "key_b").distinct())
    sides = [weighed.select("word", F.col("key").alias(f"key_{e}"), F.col("w").alias(f"w_{e}")) for e in "ab"]
    both = met.join(sides[0], "key_a").join(sides[1], ["key_b", "word"])
    verified = both.groupBy("key_a", "key_b").agg(F.round(F.sum(F.col("w_a") * F.col("w_b")), 4).alias("similarity")).where(F.col("similarity") >= least)
    named = [texts.select(F.col("key").alias(f"key_{e}"), F.col("text").alias(f"text_{e}")) for e in "ab"]
    out = verified.join(named[0], "key_a").join(named[1], "key_b")
    return out.select(F.least("text_a", "text_b").alias("text_a"), F.greatest("text_a", "text_b").alias("text_b"), "similarity")
