"""The training-data pipeline over ``documents``: filter, deduplicate, decontaminate, pack.

Every stage takes all rows that the one before it kept, and all but the last return the columns of ``documents``.

Defined results: a row is judged by its own text, so of rows that share a doc_id the toxic or contaminated ones go and the others
stay, also where doc_id is null. Near dedup keeps one row of each group, and of rows that share a doc_id the one whose text, then
whose row, has the smallest hash; rows with a null
doc_id or without words take no part in it and stay. A null text is carried along and packed as an empty one. Empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, fresh, small, stored
from worksift.llm.op1_minhash import near_duplicates
from worksift.llm.op4_decontaminate import contamination
from worksift.llm.op5_line_dedup import drop_repeated_lines
from worksift.llm.op7_toxicity import toxicity
from worksift.llm.op9_packing import pack, pieces


def _judged(docs: DataFrame) -> DataFrame:
    """What tells rows apart: (doc_id, text_key, text)."""
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows that aren't ``rejected`` (doc_id, text_key). Short lists of these are broadcast, so that texts stay where they are."""
    doc, key = fresh(docs, "rejected_doc", "rejected_key")
    rejected = small(cut(rejected.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()))
    same = docs["doc_id"].eqNullSafe(rejected[doc]) & (F.xxhash64(docs["text"].cast("string")) == rejected[key])
    return docs.join(rejected, same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts to be toxic."""
    scored = toxicity(_judged(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; documents stay, also empty ones."""
    left = drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id."""
    gone = small(cut(near_duplicates(docs).where("not kept").select("doc_id").distinct()))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = cut(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left
    twice = small(twice)
    row = F.struct(*docs.columns)
    order = F.struct(F.xxhash64(F.col("text").cast("string")), F.xxhash64(*docs.columns))
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    found = contamination(_judged(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(F.size("items") > 0))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces with their token ids and places in sequences. Places are found on rows without ids."""
    made = stored(pieces(docs).withColumn("row", F.monotonically_increasing_id()))
    return pack(made.drop("ids")).join(made.select("row", "ids"), "row").drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Scores and tokens aren't expressible in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is stored as a compressed table, because the next one reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
