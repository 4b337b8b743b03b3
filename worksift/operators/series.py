"""Change points, monthly series, their classification and the share radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worksift.config import CONFIG, Config
from worksift.operators.peers import medians, ordered, quantile
from worksift.plans.lineage import cut


def change_points(works: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Agencies whose yearly median amount moved by more than half between consecutive kept years."""
    rows = works.where(F.col("recommendation_date").isNotNull() & F.col("implementing_agency").isNotNull())
    rows = rows.select("implementing_agency", F.year("recommendation_date").alias("year"), "recommended_amount")
    keys = ["implementing_agency", "year"]
    counts = cut(rows.groupBy(*keys, "recommended_amount").agg(F.count("*").alias("c")))  # medians and sizes read it
    places = ordered(counts.where(F.col("recommended_amount").isNotNull()), keys, "recommended_amount").groupBy(*keys).agg(quantile("recommended_amount", 0.5).alias("median"))
    years = counts.groupBy(*keys).agg(F.sum("c").alias("n")).where(F.col("n") >= config.min_year_works).join(places, keys, "left").select(*keys, "n", "median")
    order = Window.partitionBy("implementing_agency").orderBy("year")
    moves = years.withColumns({"before": F.lag(F.struct("year", "n", "median")).over(order)}).where("before is not null")
    moves = moves.withColumn("moved", F.abs(F.col("median") - F.col("before.median")) / (F.col("before.median") + 1e-9))
    best = moves.groupBy("implementing_agency").agg(F.max("moved").alias("moved"), F.bool_or(F.col("moved").isNull()).alias("unknown"), F.max(F.struct("moved", (-F.col("year")).alias("minus"), "before", F.struct("year", "n", "median").alias("after"))).alias("at"))
    best = best.where(~F.col("unknown") & (F.col("moved") > config.min_shift))
    return best.select("implementing_agency", F.least("moved", F.lit(1.0)).alias("change_point"), F.col("at.before.year").alias("year_before"), F.col("at.before.median").alias("median_before"), F.col("at.after.year").alias("year_after"), F.col("at.after.median").alias("median_after"))


def volumes(works: DataFrame, *keys: str) -> DataFrame:
    """Works and total amount of each (keys, month)."""
    return _dated(works, *keys).groupBy(*keys, "period").agg(F.count("*").alias("works"), F.sum("recommended_amount").alias("total_amount"))


def _dated(works: DataFrame, *keys: str) -> DataFrame:
    rows = works.where(F.col("recommendation_date").isNotNull()).where(" and ".join(["true", *(f"{k} is not null" for k in keys)]))
    return rows.select(*keys, F.trunc("recommendation_date", "month").alias("period"), "recommended_amount")


def monthly(works: DataFrame, *keys: str) -> DataFrame:
    """Works, median and total amount of each (keys, month); medians come from counts of values, so no task holds a month's amounts."""
    rows = _dated(works, *keys)
    return volumes(works, *keys).join(medians(rows, [*keys, "period"], "recommended_amount", "median_amount"), [*keys, "period"], "left")


def national_series(works: DataFrame) -> DataFrame:
    """The monthly series without its last, partial month, unless that is the only one."""
    series = monthly(works)
    ends = series.agg(F.max("period").alias("_last"), F.count("*").alias("_n"))  # one row
    return series.crossJoin(F.broadcast(ends)).where((F.col("_n") == 1) | (F.col("period") < F.col("_last"))).drop("_last", "_n")


def classify(points: DataFrame, key: str, order: str, value: str, config: Config = CONFIG) -> DataFrame:
    """One row for each key: periods and the class of its series; the last three points are compared with those before."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = points.where(F.col(value).isNotNull()).withColumn("_back", back)
    x = F.col(value).cast("double")
    old, new = F.when(F.col("_back") > 3, x), F.when(F.col("_back") <= 3, x)
    stats = rows.groupBy(key).agg(F.count("*").alias("periods"), F.sum(x).alias("total"), F.max(F.when(F.col("_back") == 1, x)).alias("latest"), F.avg(x).alias("mean"), F.avg(old).alias("mu"), F.stddev_pop(old).alias("sd"), F.avg(new).alias("recent"), F.median(x).alias("median"))
    sigma = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9)
    shift = (F.col("recent") - F.col("mu")) / (F.abs("mu") + 1e-9)
    kind = (
        F.when(F.col("periods") < config.min_periods, "INSUFFICIENT_HISTORY")
        .when((F.abs(shift) >= config.persistent_ratio) & (F.abs(F.col("recent") - F.col("mu")) > sigma), "PERSISTENT_CHANGE")
        .when(F.abs((F.col("latest") - F.col("mu")) / sigma) >= config.spike_z, "SUDDEN_CHANGE")
        .when((shift > config.emerging_shift) & (F.col("mu") < F.col("median")), "EMERGING")
        .otherwise("NORMAL")
    )
    return stats.select(key, "periods", "total", "latest", "mean", shift.alias("shift"), kind.alias("classification"))


def entity_trends(works: DataFrame, key: str, config: Config = CONFIG) -> DataFrame:
    """Classified monthly volumes of each entity with enough months."""
    return classify(volumes(works, key), key, "period", "works", config).where(F.col("periods") >= config.min_periods)


def share_radar(works: DataFrame, key: str) -> DataFrame:
    """Each key's share of the last twelve months against its share before."""
    rows = works.where(F.col("recommendation_date").isNotNull() & F.col(key).isNotNull()).select(key, F.trunc("recommendation_date", "month").alias("period"))
    cutoff = rows.agg(F.add_months(F.max("period"), -12).alias("cutoff"))  # one row
    recent = F.col("period") > F.col("cutoff")
    counts = rows.crossJoin(F.broadcast(cutoff)).groupBy(key).agg(F.count_if(recent).alias("recent_works"), F.count_if(~recent).alias("earlier_works"))
    totals = counts.agg(F.sum("recent_works").alias("_r"), F.sum("earlier_works").alias("_e"))  # one row
    shares = counts.crossJoin(F.broadcast(totals)).where("_r > 0 and _e > 0").withColumns({"recent_share": F.col("recent_works") / F.col("_r"), "earlier_share": F.col("earlier_works") / F.col("_e")})
    delta = F.col("recent_share") - F.col("earlier_share")
    shares = shares.withColumns({"delta": delta, "growth": delta / (F.col("earlier_share") + 1e-6)})
    kind = F.when((F.col("earlier_share") < 0.002) & (F.col("recent_share") > 0.005), "EMERGING").when(F.col("growth") > 0.5, "GROWING").when(F.col("growth") < -0.4, "DECLINING").otherwise("STABLE")
    return shares.select(key, "recent_works", "recent_share", "earlier_share", "delta", "growth", kind.alias("classification"))
