"""Lifecycle features and comparison with peers through hierarchical back-off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksift.config import CONFIG, Config
from worksift.plans.lineage import BROADCAST_BYTES, cut, small, stored


def add_category(works: DataFrame) -> DataFrame:
    """The activity behind the dash of a composite name."""
    parsed = F.trim(F.regexp_extract("activity_name", r"(?s)^WS/MP[^/]*/[^/]*/[^-/]*-(.*)$", 1))
    return works.withColumn("activity_category", F.coalesce(F.nullif(parsed, F.lit("")), F.lit("Uncategorised")))


def add_features(works: DataFrame) -> DataFrame:
    """Right-censored durations at the snapshot."""
    valid = F.col("is_completed") & ~F.col("is_backdated") & ~F.col("is_future_dated")
    days = F.when(valid, F.datediff("completion_date", "recommendation_date")).otherwise(F.datediff("snapshot", "recommendation_date"))
    return works.withColumns({"event_observed": valid.cast("int"), "duration_days": F.when(days >= 0, days.cast("double")), "log_amount": F.log1p("recommended_amount"), "is_open": ~F.col("is_completed")})


def ordered(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` (keys, value, c) with ``before``, the count of smaller values, and ``n``, the count of all, for each key.

    No window spans a key: values fall into bins in their order, 64 an octave, which are summed first; then each bin on its own.
    """
    v = F.col(value).cast("double")
    counts = counts.withColumn("_bin", F.signum(v) * F.floor(64 * F.log2(1 + F.abs(v))))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("c").alias("_c"))
    lower = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_below"), F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return counts.join(bins, [*keys, "_bin"]).withColumn("before", F.col("_below") + F.col("_inside")).drop("_bin", "_below", "_inside")


def placed(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` (value, c), values distinct, with ``before``, the count of smaller values, and ``n``, the count of all.

    Values are dealt to range partitions, whose sizes give each its start, so no task sorts more than its partition however close
    values lie. The partitions are materialised: a task that runs again must not see other bounds.
    """
    ranged = cut(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum("c").alias("_c"))  # one row a partition
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_below"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("n"))
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return ranged.join(F.broadcast(parts), "_part").withColumn("before", F.col("_below") + F.col("_inside")).drop("_part", "_below", "_inside")


def quantile(value: str, p: float) -> Column:
    """The quantile of ``ordered`` rows as an aggregate: linear between the two values around it."""
    at = p * (F.col("n") - 1)

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col(value)))

    low, high = value_at(F.floor(at)), value_at(F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))


def medians(rows: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """(keys, out): the exact median of each group's values that aren't null, from counts of values; ``keys`` may be empty."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c"))
    return ordered(counts.withColumn("_whole", F.lit(0)), [*keys, "_whole"], column).groupBy(*keys).agg(quantile(column, 0.5).alias(out))


def median_of_all(rows: DataFrame, column: str, out: str) -> DataFrame:
    """(out): one row, the exact median of all values that aren't null; null without any."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    return placed(counts, column).agg(quantile(column, 0.5).alias(out))


def places_of(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``ordered`` counts of the values that aren't null."""
    return ordered(rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c")), keys, column)


def percentiles(rows: DataFrame, column: str, keys: list[str], out: str, places: DataFrame | None = None) -> DataFrame:
    """(keys, column, out): leave-one-out percentile of each value among the rows with the same ``keys``.

    Ranks are averages; nulls are counted but not ranked. ``places`` are the rows' ``places_of``, if they are at hand.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    places = (places_of(rows, column, keys) if places is None else places).join(sizes, keys)
    return places.select(*keys, column, ((F.col("before") + (F.col("c") - 1) / 2) / F.nullif(F.col("_all") - 1, F.lit(0))).alias(out))


def spreads(rows: DataFrame, column: str, key: str, places: DataFrame | None = None) -> DataFrame:
    """(key, _m, _q1, _q3, _mad): median, quartiles and 1.4826 times the median absolute deviation, from counts of values.

    ``places`` are the rows' materialised ``places_of``, if they are at hand.
    """
    counts = cut(places_of(rows, column, [key])) if places is None else places
    middle = counts.groupBy(key).agg(quantile(column, 0.5).alias("_m"), quantile(column, 0.25).alias("_q1"), quantile(column, 0.75).alias("_q3"))
    middle = small(cut(middle))
    away = counts.select(key, column, "c").join(middle, key).groupBy(key, F.abs(F.col(column) - F.col("_m")).alias("_d")).agg(F.sum("c").alias("c"))
    spread = ordered(away, [key], "_d").groupBy(key).agg((1.4826 * quantile("_d", 0.5)).alias("_mad"))
    return small(cut(middle.join(spread, key)))


def robust_z(column: str) -> Column:
    """(x - median) / (1.4826 MAD), by quartiles if that is 0, else 0; of rows with ``spreads``."""
    x, iqr = F.col(column), (F.col("_q3") - F.col("_q1")) / 1.349
    z = F.when(F.col("_mad") > 0, (x - F.col("_m")) / F.nullif("_mad", F.lit(0.0))).when(iqr > 0, (x - F.col("_m")) / F.nullif(iqr, F.lit(0.0))).otherwise(0.0)
    return F.when(x.isNull() & ((F.col("_mad") > 0) | (iqr > 0)), None).otherwise(z)


def add_peers(works: DataFrame, config: Config = CONFIG, min_peers: int | None = None) -> DataFrame:
    """Assign the narrowest level with enough works, and compare each work with those of its group: see ``peer_columns``."""
    works = stored(works)  # several aggregates read it
    return peer_columns(works, config, min_peers)(works)


def peer_columns(works: DataFrame, config: Config = CONFIG, min_peers: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """What adds the peers' columns to the rows of the stored table ``works``: category and state, category, state, all.

    A work is scored among those assigned to the same group; the recorded size is the whole level's. Counts are aggregates of
    the counts by category and state, of which there are few rows. Percentiles are tables of values, made once: where they are small, adding them
    shuffles no work.
    """
    least = min_peers or config.min_peers
    both = ["activity_category", "state_name"]
    cells = cut(works.groupBy(*both).agg(F.count("*").alias("_n0")))
    total = cells.agg(F.sum("_n0").alias("_all"))  # one row
    for k, column in enumerate(both, 1):
        sums = cells.groupBy(F.col(column).alias("_key")).agg(F.sum("_n0").alias(f"_n{k}"))
        cells = cells.join(sums, F.col(column).eqNullSafe(F.col("_key"))).drop("_key")
    cells = cells.crossJoin(F.broadcast(total))
    names = [("cat_state", F.concat_ws("|", *both)), ("cat", F.col("activity_category")), ("state", F.col("state_name"))]
    level, group, size = F.lit("global"), F.lit("GLOBAL"), F.col("_all")
    for k in (2, 1, 0):
        take = F.col(f"_n{k}") >= least
        level, group, size = F.when(take, names[k][0]).otherwise(level), F.when(take, F.concat(F.lit(f"{names[k][0]}:"), names[k][1])).otherwise(group), F.when(take, F.col(f"_n{k}")).otherwise(size)
    cells = small(cut(cells.select(F.col(both[0]).alias("_cat"), F.col(both[1]).alias("_state"), level.alias("peer_level"), group.alias("peer_group_id"), size.alias("peer_group_size"))), 200)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(cells, F.col(both[0]).eqNullSafe(F.col("_cat")) & F.col(both[1]).eqNullSafe(F.col("_state"))).drop("_cat", "_state")

    key, rows = "peer_group_id", grouped(works.select(*both, "recommended_amount", "duration_days", "is_open"))
    places = cut(places_of(rows, "recommended_amount", [key]))
    amounts = small(cut(percentiles(rows, "recommended_amount", [key], "amount_pct", places)), 120)
    spread = spreads(rows, "recommended_amount", key, places)
    durations = small(cut(percentiles(rows.where("is_open"), "duration_days", [key, "is_open"], "open_duration_pct")), 120)

    def add(rows: DataFrame) -> DataFrame:
        out = grouped(rows).join(amounts, [key, "recommended_amount"], "left").join(spread, key, "left")
        out = out.withColumn("amount_z", robust_z("recommended_amount")).drop("_m", "_q1", "_q3", "_mad")
        return out.join(durations, [key, "is_open", "duration_days"], "left")

    return add


def survival_risk(works: DataFrame, key: str = "activity_category", horizon: int = CONFIG.horizon_days) -> DataFrame:
    """(key, risk): 1 minus the Kaplan-Meier survival at the horizon, by group. Windows run over distinct days."""
    days = works.where(F.col("duration_days").isNotNull()).groupBy(key, "duration_days").agg(F.sum("event_observed").alias("d"), F.count("*").alias("n"))
    at_risk = F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("duration_days")))
    days = days.withColumn("at_risk", at_risk).where(F.col("duration_days") <= horizon)
    dies = F.col("d") == F.col("at_risk")
    logs = F.sum(F.when(dies, 0.0).otherwise(F.log(1 - F.least(F.col("d") / F.col("at_risk"), F.lit(1 - 1e-15)))))
    return days.groupBy(key).agg(logs.alias("_log"), F.max(dies).alias("_zero")).select(key, F.when(F.col("_zero"), 1.0).otherwise(1 - F.exp("_log")).alias("km_risk"))


def add_risk(works: DataFrame, risk: DataFrame, key: str = "activity_category", column: str = "km_risk") -> DataFrame:
    """Attach a risk table: clipped, 0 for missing and completed, with its basis."""
    return with_risk(works.join(risk.select(key, F.col(column).alias("_risk")), key, "left"))


def with_risk(joined: DataFrame) -> DataFrame:
    """The same of rows with their ``_risk``, which may be null."""
    score = F.when(F.col("is_completed"), 0.0).otherwise(F.least(F.greatest(F.coalesce("_risk", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return joined.withColumns({"risk_score": score, "risk_level_used": F.when(F.col("_risk").isNotNull(), "model").otherwise("unscored")}).drop("_risk")


def add_archetypes(works: DataFrame, assigned: DataFrame, catalog: DataFrame) -> DataFrame:
    """Description to cluster (by its hash and text), and cluster to its label; works without either keep defaults.

    Both are one table of descriptions, which is broadcast where it is small: works then stay where they are.
    """
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("work_description"))
    named = assigned.select("work_description", "archetype_id").join(catalog.select("archetype_id", "archetype_label"), "archetype_id", "left")
    held = named.agg(F.sum(F.octet_length("work_description") + 100).alias("bytes")).first()["bytes"] or 0
    named = hashed(named)
    out = hashed(works).join(F.broadcast(named) if held <= BROADCAST_BYTES else named, ["_hash", "work_description"], "left").drop("_hash")
    return out.withColumns({"archetype_id": F.coalesce("archetype_id", F.lit(-1)), "archetype_label": F.coalesce("archetype_label", F.lit("Unassigned"))})
