"""Counters over several batches."""

from worksift.streaming import live

SCHEMA = "outcome string, work_ref string"


def test_live_works_are_exact_over_batches(spark, tmp_path):
    """A work that comes again in a later batch counts once an outcome, a null work never; a frequent outcome is one of many keys."""
    batches = [[("seen", f"W{k % 50}") for k in range(300)] + [("odd", None), (None, "W1")], [("seen", f"W{k}") for k in range(40, 60)] + [("late", "W1"), ("late", "W1")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = live.run_available(live.live_works(stream), "works_by_outcome", "complete", str(tmp_path / "works"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    live.run_available(live.live_counters(stream), "records_by_outcome", "complete", str(tmp_path / "records"))
    assert {r.outcome: r.works for r in spark.table("works_by_outcome").collect()} == {"seen": 60, "odd": 0, "late": 1, None: 1}
    assert {r.outcome: r.records for r in spark.table("records_by_outcome").collect()} == {"seen": 320, "odd": 1, "late": 2, None: 1}
