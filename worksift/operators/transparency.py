"""Where each figure comes from, how complete its column is, and what the data cannot tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of provenance.
DIRECT, DERIVED, UNAVAILABLE = "Direct measurement", "Model-derived", "Unavailable"

#: (metric, kind, confidence, column that carries it, note). A metric without a column is not in the data at all.
REGISTRY = [
    ("Works", DIRECT, "High", "work_ref", "every row of the portfolio is one work"),
    ("Recommended amount", DIRECT, "High", "recommended_amount", "what was asked for, not what was spent"),
    ("Recommendation date", DIRECT, "High", "recommendation_date", "start of the durations"),
    ("Completion", DIRECT, "High", "is_completed", "a completion record exists"),
    ("Description", DIRECT, "High", "work_description", "free text, compared as it is"),
    ("Agency", DIRECT, "High", "implementing_agency", "as named in the export"),
    ("Category", DIRECT, "Medium", "activity_category", "parsed from the composite activity name"),
    ("Archetype", DERIVED, "Medium", "archetype_label", "unsupervised groups of descriptions; silhouette measures separation only"),
    ("Amount percentile", DERIVED, "High", "amount_pct", "rank among peers without the work itself"),
    ("Completion risk", DERIVED, "Medium", "risk_score", "orders works by how soon they end; not a chance of wrongdoing"),
    ("Early warning", DERIVED, "Medium", "early_warning_level", "risk and stalling together"),
    ("Similar works", DERIVED, "Medium", "sig_duplicate", "repeated descriptions are often legitimate"),
    ("Exposure", DERIVED, "Medium", "rs_exposure", "amount times risk; not a loss"),
    ("Actual expenditure", UNAVAILABLE, "None", None, "the recorded actual amount repeats the recommended one"),
    ("Payment tranches", UNAVAILABLE, "None", None, "no payment records in the exports"),
    ("Cost estimate", UNAVAILABLE, "None", None, "amounts are compared with peers instead"),
    ("Physical progress", UNAVAILABLE, "None", None, "only administrative stages are recorded"),
    ("Sanction date", UNAVAILABLE, "None", None, "sanction rows carry no date of their own"),
    ("Vendor", UNAVAILABLE, "None", None, "no contractor is named"),
    ("Location", UNAVAILABLE, "None", None, "no coordinates; the constituency is the finest place"),
]


def provenance(works: DataFrame) -> DataFrame:
    """(metric, type, confidence, note, present_pct): the registry with the measured completeness of each column, in one aggregate.

    A column that the works don't carry, and an unavailable metric, is 0 % present; of no works nothing is present.
    """
    share = lambda c: F.coalesce(F.round(100 * F.avg(F.col(c).isNotNull().cast("double")), 2), F.lit(0.0))
    wide = works.agg(*(share(c).alias(f"p{i}") if c in works.columns else F.lit(0.0).alias(f"p{i}") for i, (*_, c, _) in enumerate(REGISTRY)), F.count("*").alias("n"))
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in (("metric", m), ("type", t), ("confidence", s), ("note", note))), F.col(f"p{i}").alias("present_pct")) for i, (m, t, s, _, note) in enumerate(REGISTRY)))
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def totals(registry: DataFrame) -> DataFrame:
    """(type, metrics, complete): metrics of each kind, and how many of them every work has."""
    return registry.groupBy("type").agg(F.count("*").alias("metrics"), F.count_if(F.col("present_pct") == 100).alias("complete"))


def limitations(registry: DataFrame) -> DataFrame:
    """(metric, why) of what the data doesn't hold."""
    return registry.where(F.col("type") == UNAVAILABLE).select("metric", F.col("note").alias("why"))


def card(stats: DataFrame, health: DataFrame, registry: DataFrame, metrics: DataFrame) -> DataFrame:
    """(part, name, value): statistics and health index as numbers, limitations with their reason, model metrics, as text."""
    names = lambda df: [c for c in df.columns]
    tall = lambda df, part: df.select(*(F.col(c).cast("string").alias(c) for c in names(df))).unpivot([], names(df), "name", "value").select(F.lit(part).alias("part"), "name", "value")
    out = tall(stats, "statistics").unionByName(tall(health, "health"))
    out = out.unionByName(limitations(registry).select(F.lit("limitation").alias("part"), F.col("metric").alias("name"), F.col("why").alias("value")))
    return out.unionByName(metrics.select(F.lit("model").alias("part"), "name", F.col("value").cast("string").alias("value")))
