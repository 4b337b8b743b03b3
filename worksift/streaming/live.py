"""Incremental forms: first-seen fingerprints on arrival, live verification counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REUSE = "fingerprint bigint, work_ref string, first_work string, at timestamp"
FIRST = "fingerprint bigint, first_work string"


def reused_fingerprints(stream: DataFrame, folder: str) -> DataFrame:
    """Processes what is there of (fingerprint, work_ref, at), and gives all rows whose fingerprint another work showed first.

    The state is a table of each fingerprint's first work below ``folder``, beside the rows found; a batch adds a part to either
    and overwrites it if it runs again. Firsts are combinable aggregates and reuses a join, so no key's rows meet in Python.
    """
    spark = stream.sparkSession
    firsts, found = f"{folder}/firsts", f"{folder}/found"

    def read(path: str, schema: str, batch: int | None = None) -> DataFrame:
        try:
            rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
        except Exception as missing:  # no batch has ended yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = spark.createDataFrame([], f"{schema}, batch bigint")
        return (rows if batch is None else rows.where(F.col("batch") < batch)).drop("batch")

    def step(rows: DataFrame, batch: int) -> None:
        known = read(firsts, FIRST, batch)
        new = rows.groupBy("fingerprint").agg(F.min(F.struct("at", "work_ref")).alias("f")).select("fingerprint", F.col("f.work_ref").alias("first_work"))
        new.join(known, "fingerprint", "left_anti").write.mode("overwrite").parquet(f"{firsts}/batch={batch}")
        all_firsts = known.unionByName(spark.read.schema(FIRST).parquet(f"{firsts}/batch={batch}"))
        again = rows.join(all_firsts, "fingerprint").where("work_ref <> first_work").select("fingerprint", "work_ref", "first_work", "at")
        again.write.mode("overwrite").parquet(f"{found}/batch={batch}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read(found, REUSE)


def live_counters(stream: DataFrame) -> DataFrame:
    """Verifications by outcome, updated with every batch."""
    return stream.groupBy("outcome").agg(F.count("*").alias("records"))


def live_works(stream: DataFrame) -> DataFrame:
    """Different works by outcome, exact, updated with every batch.

    The state store holds each (outcome, work) once, dealt by both, so a batch costs by its own rows and a frequent outcome isn't one
    task. A null work isn't counted; an outcome without any has 0.
    """
    return stream.dropDuplicates(["outcome", "work_ref"]).groupBy("outcome").agg(F.count("work_ref").alias("works"))


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Process what is there into an in-memory table, and wait."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
