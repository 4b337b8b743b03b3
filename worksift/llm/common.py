"""Helpers that several operators share: lineage cuts, skew-safe joins and running sums, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worksift.plans.lineage import shared_folder

#: ASCII white space, as a Java regular expression: space and \t..\r.
SPACE = r"[\x20\x09-\x0D]+"
#: Keys of a skew-safe join that are broadcast, at most; short rows each.
HOT_KEYS = 100_000
#: Rows that a key needs at least to be called hot.
HOT_ROWS = 5_000
#: Bytes that a broadcast side may have, by its counted rows.
BROADCAST_BYTES = 64 << 20


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with ``checkpoint()`` in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder: for texts and arrays, of which readers want some columns."""
    path = f"{_checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of our own, see ``lineage.shared_folder``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark))
    return context.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed until none is a column of ``df``, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, row_bytes: int = 48, array: str | None = None) -> DataFrame:
    """A materialised side of a join, marked for broadcast if its rows fit ``BROADCAST_BYTES``: ``row_bytes`` each, and 8 an ``array`` item."""
    items = F.sum(F.size(array)) if array else F.lit(0)
    n = df.agg((F.count("*") * row_bytes + F.coalesce(items, F.lit(0)) * 8).alias("n")).first()["n"]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", weight: str | None = None) -> DataFrame:
    """Materialised ``rows`` joined (inner or left) with ``facts``, so that a key with a third of all rows isn't dealt to one task.

    Rows of a hot key are dealt to several tasks by a salt, and each of these gets the key's facts. Hot keys are found by
    counting ``rows``, or where facts have a ``weight``, the count of their key's rows, by that. Rows with a null key meet nothing.
    Facts with a weight are short rows: if they fit ``BROADCAST_BYTES`` they are broadcast, and nothing is dealt anew.
    """
    if weight and how == "inner" and facts.count() * 64 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts.drop(weight)), keys)
    if weight:
        counted = facts.select(*keys, F.col(weight).alias("count"))
        facts = facts.drop(weight)
    else:
        counted = rows.groupBy(*keys).count()
    total = counted.agg(F.sum("count")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    known = " and ".join(f"`{k}` is not null" for k in keys)
    hot = cut(counted.where(F.col("count") > limit).where(known).select(*keys, F.ceil(F.col("count") / limit).cast("long").alias("fan")))
    without = rows.where(f"not ({known})")
    if hot.isEmpty():
        out = rows.where(known).join(facts, keys, how)
    else:
        fan, salt = fresh(rows.join(facts.limit(0), keys, "left"), "fan", "salt")
        hot = F.broadcast(hot.withColumnRenamed("fan", fan))  # at most HOT_KEYS rows
        salted = rows.where(known).join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.coalesce(fan, F.lit(1)))).drop(fan)
        copied = facts.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(fan, F.lit(1)) - 1))).drop(fan)
        out = salted.join(copied, [*keys, salt], how).drop(salt)
    return out if how == "inner" else out.unionByName(without, allowMissingColumns=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, although ``body`` uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add each of ``values`` summed over the rows of the same ``keys`` that come before in ``order``.

    A key with a third of all rows isn't summed in one task. Rows are dealt by range of (keys, order), so a hot
    key spans many blocks; each block is summed on its own, and only the blocks' totals (one row for each key and
    block) are summed in order. ``keys`` hold no nulls. The blocks are cut by a checkpoint, because both passes must
    see the same ones, also after a lost executor.
    """
    block, *names = fresh(df, "block", *(f"{part} {k}" for part in ("value", "total", "base", "inside") for k in values))
    value, total, base, inside = (names[i * len(values) : (i + 1) * len(values)] for i in range(4))
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order)
    dealt = cut(dealt.withColumns({block: F.spark_partition_id(), **dict(zip(value, values.values(), strict=True))}))
    by = [*keys, block]
    totals = dealt.groupBy(*by).agg(*(F.sum(v).alias(t) for v, t in zip(value, total, strict=True)))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, *(F.coalesce(F.sum(t).over(before), F.lit(0)).alias(n) for t, n in zip(total, base, strict=True)))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(n) for v, n in zip(value, inside, strict=True)))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return summed.join(totals, by).select(*kept, *((F.col(n) + F.col(m)).cast("long").alias(k) for n, m, k in zip(base, inside, values, strict=True)))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, keys, order, {out: value})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b) as (node, root): root is the smallest node reachable.

    Alternates two contractions until nothing changes: every node links its larger neighbours to its smallest one,
    then every node and its smaller neighbours link to the smallest of these. The count of rounds follows the
    logarithm of the largest component; a round is joins and aggregates, and a hot node's rows can be split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small_.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
