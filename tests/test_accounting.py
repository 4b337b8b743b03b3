"""Exact concordance, hash chains, profiles, paired dates and accounted writes, against brute force."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from worksift.operators import fusion, models, peers, transparency
from worksift.sources import ingest


def pair_counts(rows):
    right = pairs = 0
    for v, t, e in rows:
        if e and None not in (v, t):
            for w, u, d in rows:
                if None not in (w, u) and (t < u or (t == u and not d)):
                    pairs += 1
                    right += 1 if v > w else 0.5 if v == w else 0
    return right / pairs if pairs else None, pairs


@pytest.mark.parametrize("spread", [1, 7, 10_000])
def test_concordance_equals_all_pairs(spark, spread):
    """Risks nearly unique, tied, and all equal; tied days; nulls."""
    rng = random.Random(spread)
    rows = [(rng.randrange(spread) / spread, float(rng.randrange(40)), int(rng.random() < 0.6)) for _ in range(1500)]
    rows += [(None, 3.0, 1), (0.5, None, 1), (-2.0, 0.0, 1), (1e9, 50.0, 0)]
    got = models.concordance(spark.createDataFrame(rows, "r double, duration_days double, event_observed int"), "r").first()
    c, n = pair_counts(rows)
    assert got["pairs"] == n and got["c_index"] == pytest.approx(c, abs=1e-12)


def test_concordance_without_pairs(spark):
    rows = spark.createDataFrame([(0.5, 1.0, 0), (0.1, 2.0, 0)], "r double, duration_days double, event_observed int")
    for x in (rows, rows.limit(0)):
        assert tuple(models.concordance(x, "r").first()) == (None, 0)


def test_median_of_all(spark):
    rows = spark.createDataFrame([(1 + i / 1e9,) for i in range(2000)] + [(None,)] * 5, "v double")
    assert peers.median_of_all(rows, "v", "m").first()["m"] == pytest.approx(1 + 999.5 / 1e9, abs=1e-15)
    assert [r["m"] for r in peers.median_of_all(rows.limit(0), "v", "m").collect()] == [None]


def test_one_long_log_is_verified_by_many_tasks(spark):
    """A log of 200,000 rows under one key, tampered in its third; another with a null key, quotes and control characters."""
    long = spark.range(1, 200_001).select(F.lit("all").alias("w"), F.col("id").alias("seq"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("detail"))
    odd = spark.createDataFrame([(None, k, d) for k, d in enumerate(('say "x"', "a\\b", "\x01\n", None, "ü"), 1)], "w string, seq long, detail string")
    chained = fusion.chain(long.unionByName(odd), "w", "seq", ["detail"])
    assert all(r.valid for r in fusion.first_break(chained, "w", "seq", ["detail"]).collect())
    first = chained.where("w = 'all' and seq = 1").first()
    assert first["row_hash"] == sha256(f'["note 1","{"0" * 64}"]'.encode()).hexdigest() and first["entry"] == 1
    hit = chained.withColumn("detail", F.when(F.expr("seq = 3 and w = 'all'"), "changed").otherwise(F.col("detail")))
    got = {r.w: (r.entries, r.valid, r.broken_at_seq, r.reason) for r in fusion.first_break(hit, "w", "seq", ["detail"]).collect()}
    assert got == {"all": (200_000, False, 3, "content"), None: (5, True, None, None)}
    gone = fusion.first_break(chained.where("not (w is null and seq = 2)"), "w", "seq", ["detail"]).where("w is null").first()
    assert (gone["entries"], gone["broken_at_seq"], gone["reason"]) == (4, 3, "link")


@pytest.mark.parametrize("sep", [",", ";"])
def test_profile_of_delimited_files(spark, tmp_path, sep):
    other = "," if sep == ";" else ";"
    lines = [sep.join(("id", "name", "blank"))] + [sep.join((str(i), f'"n{i % 7}{other}{sep}"', " ")) for i in range(300)]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    df = ingest.read_delimited(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["id", "name", "blank"]
    got = {r.column_name: r for r in ingest.profile(df).collect()}
    assert (got["id"].n_rows, got["id"].n_distinct, got["id"].inferred_type, got["id"].capped) == (300, 300, "integer", False)
    assert (got["name"].n_distinct, got["name"].inferred_type) == (7, "text") and set(got["name"].samples) <= {f"n{i}{other}{sep}" for i in range(7)}
    assert len(got["id"].samples) == 5 and (got["blank"].n_null, got["blank"].n_distinct, got["blank"].inferred_type, list(got["blank"].samples)) == (300, 0, "empty", [])
    capped = {r.column_name: (r.n_distinct, r.capped) for r in ingest.profile(df, cap=50).collect()}
    assert capped == {"id": (50, True), "name": (7, False), "blank": (0, False)}
    assert {r.column_name: r.samples for r in ingest.profile(df.repartition(7)).collect()} == {c: r.samples for c, r in got.items()}


def test_paired_dates(spark):
    rows = [("a", "R", 5, 1), ("a", "R", 9, 2), ("a", "S", 5, 3), ("b", "R", None, 1), ("b", "R", 4, 2), ("b", "S", 4, 1), ("c", "R", 1, 1), ("d", "R", 1, 1), ("d", "S", 2, 0), (None, "R", 1, 1), (None, "S", 1, 1)]
    got = ingest.paired_dates(spark.createDataFrame(rows, "w string, s string, d int, o int"), "w", "s", "d", "o", "R", "S").collect()
    assert {tuple(r) for r in got} == {("a", 5, 5, True), ("d", 1, 2, False)}


def test_accounted_write_counts_and_guards(spark, tmp_path):
    rows = spark.range(10).withColumn("late", F.col("id") > 6)
    assert ingest.accounted_write(rows, str(tmp_path / "x"), {"late": F.col("late")}, 10) == {"all_works": 10, "late": 3}
    assert spark.read.parquet(str(tmp_path / "x")).count() == 10
    with pytest.raises(Exception, match="accounted write"):
        ingest.accounted_write(rows, str(tmp_path / "y"), {"late": F.col("late")}, 11)


def test_provenance_measures_what_is_there(spark):
    works = spark.createDataFrame([("a", 1.0, None), ("b", None, "x")], "work_ref string, recommended_amount double, work_description string")
    got = {r.metric: r.present_pct for r in transparency.provenance(works).collect()}
    assert got["Works"] == 100 and got["Recommended amount"] == got["Description"] == 50 and got["Archetype"] == got["Vendor"] == 0
    assert {r.type: r.metrics for r in transparency.totals(transparency.provenance(works.limit(0))).collect()} == {"Direct measurement": 7, "Model-derived": 6, "Unavailable": 7}
    assert transparency.limitations(transparency.provenance(works)).count() == 7
