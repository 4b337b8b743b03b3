"""Typed CSV scan of stage exports, with accounting; grains, dedup, conformance; profiles and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksift.plans.lineage import cut

#: The contract's raw columns, their names and target types.
CONTRACT = {
    "house": ("house_code", "string"), "mp_id": ("mp_id", "bigint"), "tile_label": ("stage", "string"),
    "WORK_RECOMMENDATION_DTL_ID": ("work_recommendation_dtl_id", "bigint"), "WORK_ID": ("portal_work_id", "bigint"), "WORK_DESCRIPTION": ("work_description", "string"),
    "ACTIVITY_NAME": ("activity_name", "string"), "WORK_CATEGORY": ("work_category", "string"), "RECOMMENDATION_DATE": ("recommendation_date", "date"), "ACTUAL_END_DATE": ("completion_date", "date"),
    "RECOMMENDED_AMOUNT": ("recommended_amount", "double"), "ACTUAL_AMOUNT": ("actual_amount", "double"), "Total_Amt": ("mp_total_amount", "double"), "AVERAGE_RATING": ("average_rating", "double"),
    "ATTACH_ID": ("attach_id", "bigint"), "FLAG": ("flag", "bigint"), "FILE_STATUS": ("file_status", "boolean"),
}
STAGES = {"Works Recommended": "RECOMMENDED", "Works Sanctioned": "SANCTIONED", "Works Completed": "COMPLETED"}
DATE_FORMAT = "dd-MMM-yyyy"


def cast_cell(raw: Column, kind: str) -> Column:
    """Bad values become null. Whole numbers are rounded half to even; booleans are read from true and false."""
    value = F.trim(raw)
    if kind == "bigint":
        return F.bround(value.try_cast("double"), 0).try_cast("bigint")
    if kind == "boolean":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    if kind == "date":
        return F.try_to_timestamp(value, F.lit(DATE_FORMAT)).cast("date")
    return value if kind == "string" else value.try_cast(kind)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """All cells of a CSV export as strings, with the file's name and the row's number in it."""
    header = spark.read.option("header", True).csv(path).columns
    unknown = sorted(set(header) - set(CONTRACT))
    if unknown:
        raise ValueError(f"columns outside the contract: {unknown}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)
    rows = rows.withColumns({"source_file": F.col("_metadata.file_name"), "_id": F.monotonically_increasing_id()})
    # A large file is split, so its rows are numbered by split: only one row for each file and split is summed in order.
    rows = rows.withColumn("_split", F.shiftright("_id", 33))
    splits = rows.groupBy("source_file", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source_file", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(splits, ["source_file", "_split"]).withColumn("raw_row_index", F.col("_id") + F.col("_shift")).drop("_id", "_split", "_shift")


def load_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of exports with differing columns, typed, with ``work_ref`` and ``bad_cells``; unknown stages fail."""
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read_export(spark, p) for p in paths))
    named = {c: CONTRACT[c] for c in CONTRACT if c in raw.columns}
    casts = {name: cast_cell(F.col(c), kind) for c, (name, kind) in named.items()}
    bad = reduce(lambda a, b: a + b, ((F.col(c).isNotNull() & casts[name].isNull()).cast("int") for c, (name, kind) in named.items() if kind != "string"), F.lit(0))
    stage = F.try_element_at(F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair)), F.trim("tile_label"))
    casts["stage"] = F.coalesce(stage, F.raise_error(F.concat(F.lit("unmapped stage: "), F.coalesce("tile_label", F.lit("null")))).cast("string"))
    out = raw.select(*(c.alias(name) for name, c in casts.items()), "source_file", "raw_row_index", bad.alias("bad_cells"))
    return out.withColumn("work_ref", F.concat(F.lit("MP"), F.col("mp_id").cast("string"), F.lit("-W"), F.col("work_recommendation_dtl_id").cast("string")))


def split_grains(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage rows, totals): rows without a serial are totals of a member and stage."""
    return raw.where("work_ref is not null"), raw.where("work_ref is null")


def build_stages(stages: DataFrame) -> DataFrame:
    """One row for each work and stage row, in lifecycle order; a sanction has no date of its own."""
    seq = F.when(F.col("stage") == "RECOMMENDED", 1).when(F.col("stage") == "SANCTIONED", 2).otherwise(3)
    day = F.when(F.col("stage") == "RECOMMENDED", F.col("recommendation_date")).when(F.col("stage") == "COMPLETED", F.col("completion_date"))
    order = Window.partitionBy("work_ref").orderBy("stage_seq", F.asc_nulls_last("stage_date"), "source_file", "raw_row_index")
    return stages.withColumns({"stage_seq": seq, "stage_date": day}).withColumn("lifecycle_order", F.row_number().over(order))


def keep_one(rows: DataFrame, key: str, day: str, ties: list[str], keep: str = "last") -> DataFrame:
    """One row for each key: the first or last by (day with nulls first, ties)."""
    order = [F.asc_nulls_first(day), *map(F.asc, ties)] if keep == "first" else [F.desc_nulls_last(day), *map(F.desc, ties)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def build_works(stages: DataFrame, ties: list[str] = ["source_file", "raw_row_index"]) -> DataFrame:  # noqa: B006
    """One row for each work_ref of any stage, with presence and conformance flags; orphans stay."""
    recommended = keep_one(stages.where("stage = 'RECOMMENDED'"), "work_ref", "recommendation_date", ties)
    completed = keep_one(stages.where("stage = 'COMPLETED'"), "work_ref", "completion_date", ties).select("work_ref", F.col("completion_date").alias("done_on"))
    present = stages.groupBy("work_ref").agg(F.min("mp_id").alias("mp_id"), *(F.max(F.col("stage") == s).alias(f"has_{s.lower()}") for s in STAGES.values()))
    anchor = stages.agg(F.max("recommendation_date").alias("snapshot"))  # one row
    works = present.join(recommended.select("work_ref", "recommendation_date", "recommended_amount"), "work_ref", "left").join(completed, "work_ref", "left").crossJoin(F.broadcast(anchor))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return works.select(
        "work_ref", "mp_id", "recommendation_date", "recommended_amount", F.col("done_on").alias("completion_date"), F.col("has_sanctioned").alias("is_sanctioned"), F.col("has_completed").alias("is_completed"),
        (~F.col("has_recommended")).alias("is_orphan"), flag(F.col("recommended_amount") <= 0).alias("has_nonpositive_amount"), flag(F.col("done_on") < F.col("recommendation_date")).alias("is_backdated"),
        flag(F.col("done_on") > F.col("snapshot")).alias("is_future_dated"), (F.col("has_completed") & ~F.col("has_sanctioned")).alias("completed_without_sanction"),
    )


def guard_rows(name: str, before: int, after: int, reason: str | None = None) -> int:
    """Rows never go silently: a changed count needs a reason."""
    if before != after and not reason:
        raise ValueError(f"{name}: {before} rows became {after} without a stated reason")
    return before - after


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fail if a key of a 1:1 join occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key occurs more than once: {twice[0].asDict()}")
    return df


def digest(df: DataFrame) -> DataFrame:
    """Row count and a digest that doesn't depend on the order of rows."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_parquet(df: DataFrame, path: str, columns: list[str]) -> str:
    """Write the columns in their fixed order; returns the content digest."""
    out = df.select(*columns)
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return out.sparkSession.read.parquet(path).transform(digest).first()["digest"]


def write_json(df: DataFrame, path: str) -> None:
    """One nested document a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str, outcomes: list[str]) -> None:
    """Append to a table that is never rewritten; an outcome outside the domain fails the whole write."""
    wrong = F.raise_error(F.concat(F.lit("unknown outcome: "), F.coalesce("outcome", F.lit("null")))).cast("string")
    rows.withColumn("outcome", F.when(F.col("outcome").isin(*outcomes), F.col("outcome")).otherwise(wrong)).write.mode("append").parquet(path)


#: Distinct values of a column that are counted, and samples that are shown.
DISTINCT_CAP = 200_000
SAMPLES = 5


def separator(spark: SparkSession, path: str) -> str:
    """``;`` or ``,``: which stands more often in the first line outside quotes; a comma if neither does."""
    first = spark.read.text(path).limit(1).select(F.regexp_replace("value", '"[^"]*"', "").alias("line")).first()
    line = first["line"] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header, all columns as text; its separator is found if none is given."""
    return spark.read.options(header=True, sep=sep or separator(spark, path), escape='"').csv(path)


def profile(df: DataFrame, cap: int | None = DISTINCT_CAP) -> DataFrame:
    """For each column: rows, nulls, distinct values up to ``cap``, or all without one, inferred type, least and greatest, up to five samples.

    Blank cells are null. One aggregate makes all but the distinct counts, with a sketch for each column, whose relative error is below
    1 %. Only columns that the sketch puts under 1.2 times the cap are counted exactly; the others have ``cap`` and ``capped``. A
    sample is the value of the least hash in each fifth of the hashes, so it does not depend on the order of rows.
    """
    filled = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns}
    aggs = [F.count("*").alias("n_rows")]
    for i, v in enumerate(filled.values()):
        h = F.xxhash64(v)
        picks = F.array(*(F.min_by(v, F.when(v.isNotNull() & (F.pmod(h, F.lit(SAMPLES)) == k), F.struct(h, v))) for k in range(SAMPLES)))
        aggs += [
            F.count(v).alias(f"n_{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(v, 14)).alias(f"e_{i}"), F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}"), F.array_sort(F.array_compact(picks)).alias(f"s_{i}"),
            F.bool_and(F.when(v.isNotNull(), v.rlike(r"^[+-]?\d+$"))).alias(f"i_{i}"), F.bool_and(F.when(v.isNotNull(), v.try_cast("double").isNotNull())).alias(f"f_{i}"),
        ]
    wide = cut(df.agg(*aggs))
    estimates = wide.select(*(F.coalesce(f"e_{i}", F.lit(0)).alias(f"e_{i}") for i in range(len(filled)))).first()  # one row
    exact = [c for i, c in enumerate(filled) if cap is None or estimates[f"e_{i}"] <= 1.2 * cap]
    kind = lambda i: F.when(F.col(f"n_{i}") == 0, "empty").when(F.col(f"i_{i}"), "integer").when(F.col(f"f_{i}"), "number").otherwise("text")
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), (F.col("n_rows") - F.col(f"n_{i}")).alias("n_null"), kind(i).alias("inferred_type"), F.col(f"lo_{i}").alias("least"), F.col(f"hi_{i}").alias("greatest"), F.col(f"s_{i}").alias("samples"), F.lit(c in exact).alias("_exact")) for i, c in enumerate(filled)))
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), filled[c].alias("value")) for c in exact or list(filled)))).alias("x")).where("x.value is not null")
    counts = cells.groupBy("x.column_name", "x.value").agg(F.lit(1).alias("one")).groupBy("column_name").agg(F.count("*").alias("_n"))
    out = wide.select(F.explode(rows).alias("x")).select("x.*").join(counts, "column_name", "left")
    n = F.when(F.col("_exact"), F.coalesce("_n", F.lit(0))).otherwise(cap)
    most, capped = (n, F.lit(False)) if cap is None else (F.least(n, F.lit(cap)), n >= cap)
    return out.select("column_name", "n_rows", "n_null", most.cast("long").alias("n_distinct"), "inferred_type", "least", "greatest", "samples", capped.alias("capped"))


def paired_dates(rows: DataFrame, key: str, stage: str, date: str, order: str, first: str, second: str) -> DataFrame:
    """(key, first_date, second_date, same) of works whose first row of both stages, by ``order``, has a date.

    One aggregate in place of two dedups and a join, so a work with very many rows is combined before it is shuffled.
    """
    head = lambda s: F.min(F.when(F.col(stage) == s, F.struct(F.col(order).alias("o"), F.col(date).alias("d"))))["d"]
    both = rows.where(F.col(stage).isin(first, second) & F.col(key).isNotNull()).groupBy(key).agg(head(first).alias("first_date"), head(second).alias("second_date"))
    return both.dropna(subset=["first_date", "second_date"]).withColumn("same", F.col("first_date") == F.col("second_date"))


def accounted_write(df: DataFrame, path: str, reasons: dict[str, Column], expected: int | None = None) -> dict[str, int]:
    """Write rows and return how many there were and how many had each reason, counted by an observation of the same pass.

    With ``expected``, another count of rows fails; then the files are there, but the caller must not use them.
    """
    seen = Observation(f"accounting-{uuid.uuid4().hex}")
    counts = [F.count("*").alias("all_works"), *(F.count_if(test).alias(name) for name, test in reasons.items())]
    df.observe(seen, *counts).write.mode("overwrite").parquet(path)
    found = dict(seen.get)
    if expected is not None:
        guard_rows("accounted write", expected, found["all_works"])
    return found
