"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from the record's key and its own id; the shard with the smallest ``-ln(u) / weight`` keeps the
record. A shard's draw doesn't depend on the others, so one more shard takes rows only into itself, and
shards get rows in proportion to their weights. Only built-in functions are used.

Defined results: a null key is a key like any other; a null text has no bytes and the checksum of an empty one; repeated
rows share a shard and get a slot each; extra columns are carried along, but for ``shard`` and ``grown_shard``, which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, running_sum

SHARDS, ROW_BYTES = 40, 16


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that wins ``key``; equal draws go to the smaller shard."""
    weight = F.array(*(F.lit(float(w)) for w in weights))

    def draw(shard: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + 1) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.element_at(weight, shard + 1)).alias("cost"), shard.alias("shard"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), draw))["shard"]


def assign(rows: DataFrame, key: Column, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """``rows`` with ``shard``, and with ``grown_shard`` under the ``grown`` weights, which start with ``weights``."""
    found = {"shard": shard_of(key, weights)} | ({} if grown is None else {"grown_shard": shard_of(key, grown)})
    return rows.withColumns(found)


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39 by doc_id alone (law ``key``), with gapless slots."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = cut(assign(rows, F.col("doc_id"), [1.0] * SHARDS, [1.0] * (SHARDS + 1)))
    placed = running_sum(dealt, ["shard"], ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
