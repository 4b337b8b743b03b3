"""Views of the star-schema tables in the shape of a works portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.plans.lineage import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order, as a work: identity, lifecycle dates and conformance flags.

    The joins say which side is dealt: a compressed file's size made Spark broadcast all orders, and one task made all works.
    """
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("shipped"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name")
    anchor = orders.agg(F.max("day").alias("snapshot"))  # one row
    done, sanctioned = F.col("o_orderstatus") == "F", F.col("shipped").isNotNull()
    completed_on = F.when(done, F.col("shipped"))
    key = F.col("o_orderkey")
    variants = [F.lit(", phase "), (key % 4 + 1).cast("string"), F.when(key % 3 == 0, " revised").otherwise(""), F.when(key % 5 == 0, " with second stage").otherwise("")]
    activity = F.concat(F.lit("WS/MP"), F.col("o_custkey").cast("string"), F.lit("/"), F.year("day").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("-"), "o_orderpriority")
    return (
        orders.hint("merge").join(small(people, 200), "o_custkey").join(shipped.hint("merge"), "o_orderkey", "left").crossJoin(F.broadcast(anchor))
        .select(
            F.concat(F.lit("MP"), F.col("o_custkey").cast("string"), F.lit("-W"), F.col("o_orderkey").cast("string")).alias("work_ref"),
            F.col("o_custkey").alias("mp_id"), F.col("c_name").alias("mp_name"), F.col("n_name").alias("state_name"), F.col("c_mktsegment").alias("constituency"),
            F.concat("n_name", F.lit("/"), "c_mktsegment").alias("implementing_agency"), activity.alias("activity_name"),
            F.concat("o_orderpriority", F.lit(" for "), "c_mktsegment", F.lit(" in "), "n_name", *variants).alias("work_description"),
            F.col("day").alias("recommendation_date"), F.col("o_totalprice").alias("recommended_amount"), sanctioned.alias("is_sanctioned"), done.alias("is_completed"),
            completed_on.alias("completion_date"), "snapshot",
            F.lit(False).alias("is_orphan"), F.coalesce(F.col("o_totalprice") <= 0, F.lit(False)).alias("has_nonpositive_amount"),
            F.coalesce(completed_on < F.col("day"), F.lit(False)).alias("is_backdated"), F.coalesce(completed_on > F.col("snapshot"), F.lit(False)).alias("is_future_dated"),
            (done & ~sanctioned).alias("completed_without_sanction"),
        )
    )


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of field verifications."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("work_ref"), F.col("event_type").alias("outcome"), F.col("value").alias("notes"), F.col("ts").alias("created_at"))


def raw_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw stage rows, all strings: what a portal export would hold."""
    serial = F.get_json_object("props", "$.k")
    stage = F.create_map(*(F.lit(x) for pair in (("signup", "Works Recommended"), ("view", "Works Sanctioned"), ("purchase", "Works Completed")) for x in pair))
    rows = table(spark, sf_dir, "events").withColumn("tile_label", F.try_element_at(stage, F.col("event_type"))).where("tile_label is not null")
    day = F.upper(F.date_format("ts", "dd-MMM-yyyy"))
    return rows.select(
        F.when(F.col("user_id") % 2 == 0, "LS").otherwise("RS").alias("house"), F.col("user_id").cast("string").alias("mp_id"), "tile_label", serial.alias("WORK_RECOMMENDATION_DTL_ID"),
        F.when(F.col("event_type") == "signup", F.initcap(F.lower(day))).alias("RECOMMENDATION_DATE"), F.when(F.col("event_type") == "purchase", F.initcap(F.lower(day))).alias("ACTUAL_END_DATE"),
        F.col("value").cast("string").alias("RECOMMENDED_AMOUNT"), F.col("event_id").cast("string").alias("ATTACH_ID"),
    )


WORKS_SQL = """
anchor AS (SELECT max(o_orderdate::DATE) AS snapshot FROM orders),
shipped AS (SELECT l_orderkey, max(l_shipdate)::DATE AS shipped FROM lineitem GROUP BY l_orderkey),
works AS (
  SELECT 'MP' || o_custkey || '-W' || o_orderkey AS work_ref, o_custkey AS mp_id, c_name AS mp_name, n_name AS state_name, c_mktsegment AS constituency,
    n_name || '/' || c_mktsegment AS implementing_agency, 'WS/MP' || o_custkey || '/' || year(o_orderdate) || '/' || o_orderkey || '-' || o_orderpriority AS activity_name,
    o_orderpriority || ' for ' || c_mktsegment || ' in ' || n_name || ', phase ' || (o_orderkey % 4 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN ' revised' ELSE '' END
      || CASE WHEN o_orderkey % 5 = 0 THEN ' with second stage' ELSE '' END AS work_description, o_orderdate::DATE AS recommendation_date, o_totalprice AS recommended_amount,
    shipped IS NOT NULL AS is_sanctioned, o_orderstatus = 'F' AS is_completed, CASE WHEN o_orderstatus = 'F' THEN shipped END AS completion_date, snapshot, false AS is_orphan,
    coalesce(o_totalprice <= 0, false) AS has_nonpositive_amount, coalesce(o_orderstatus = 'F' AND shipped < o_orderdate::DATE, false) AS is_backdated,
    coalesce(o_orderstatus = 'F' AND shipped > snapshot, false) AS is_future_dated, o_orderstatus = 'F' AND shipped IS NULL AS completed_without_sanction
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN shipped ON l_orderkey = o_orderkey, anchor)"""
