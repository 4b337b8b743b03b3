"""Consistency checks, early warning, signal fusion and case files."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksift.config import CONFIG, Config
from worksift.operators.peers import median_of_all, medians
from worksift.plans.lineage import cut, small

#: Each check's authority and severity.
CHECKS = {
    "completed_without_sanction": ("OBSERVED_BASELINE", "HIGH"),
    "completion_before_recommendation": ("OBSERVED_BASELINE", "HIGH"),
    "completion_beyond_snapshot": ("OBSERVED_BASELINE", "MEDIUM"),
    "missing_recommendation_record": ("OBSERVED_BASELINE", "HIGH"),
    "non_positive_amount": ("OBSERVED_BASELINE", "MEDIUM"),
    "missing_description": ("OBSERVED_BASELINE", "LOW"),
    "stalled_beyond_peer_norm": ("STATISTICAL_OUTLIER", "MEDIUM"),
    "amount_outlier_vs_peers": ("STATISTICAL_OUTLIER", "MEDIUM"),
}
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SIGNALS = list(CONFIG.weights)


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def add_checks(works: DataFrame) -> DataFrame:
    """Eight booleans, how many fired, and the worst severity."""
    fired = {
        "completed_without_sanction": F.col("completed_without_sanction"), "completion_before_recommendation": F.col("is_backdated"), "completion_beyond_snapshot": F.col("is_future_dated"),
        "missing_recommendation_record": F.col("is_orphan"), "non_positive_amount": F.col("has_nonpositive_amount"), "missing_description": F.col("work_description").isNull(),
        "stalled_beyond_peer_norm": F.col("is_open") & (F.col("open_duration_pct") >= 0.99), "amount_outlier_vs_peers": F.col("amount_pct") >= 0.99,
    }
    works = works.withColumns({f"chk_{k}": is_true(v) for k, v in fired.items()})
    rank = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
    worst = F.greatest(*(F.when(F.col(f"chk_{k}"), rank[severity]).otherwise(0) for k, (_, severity) in CHECKS.items()))
    return works.withColumns({"compliance_flags": reduce(lambda a, b: a + b, (F.col(f"chk_{k}").cast("int") for k in CHECKS)), "compliance_severity": F.element_at(F.array(*map(F.lit, ("NONE", "LOW", "MEDIUM", "HIGH"))), worst + 1)})


def completed_medians(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Median durations of the completed works: (activity_category, state_name, _peer), and one row (_all) of all."""
    done = works.where("is_completed")
    return small(cut(medians(done, ["activity_category", "state_name"], "duration_days", "_peer")), 200), cut(median_of_all(done, "duration_days", "_all"))


def add_early_warning(works: DataFrame, durations: DataFrame | None = None, config: Config = CONFIG, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Risk blended with how long a work is open relative to completed peers.

    ``durations`` are the same works at hand as a table: three aggregates or joins of ``works`` would make them three times. ``found`` are
    their ``completed_medians``, if these are at hand.
    """
    peers, national = found or completed_medians(works if durations is None else durations)
    fallback = F.when(F.col("_all") == 0, config.default_peer_days).otherwise(F.col("_all"))
    works = works.join(peers, ["activity_category", "state_name"], "left").crossJoin(F.broadcast(national)).withColumn("peer_median_days", F.coalesce("_peer", fallback)).drop("_peer", "_all")
    works = works.withColumn("stall_ratio", F.when(F.col("is_open"), F.col("duration_days") / F.greatest("peer_median_days", F.lit(float(config.stall_floor_days)))))
    stall = F.coalesce("stall_ratio", F.lit(0.0))
    works = works.withColumn("early_warning_score", F.when(F.col("is_open"), clip(0.6 * clip(F.coalesce("risk_score", F.lit(0.0))) + 0.4 * clip(stall / 3.0))).otherwise(0.0))
    score = F.round("early_warning_score", 12)
    level = F.when(~F.col("is_open"), "LOW").when((score >= 0.75) & (stall >= 2.0), "CRITICAL").when(score >= 0.60, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")
    works = works.withColumn("early_warning_level", level)
    parts = F.array_compact(F.array(
        F.when(F.col("stall_ratio") >= 1.2, F.concat(F.format_string("open %.1f times as long as its completed peers (%d days)", F.col("stall_ratio"), F.col("peer_median_days").cast("long")))),
        F.when(F.col("risk_score") >= 0.4, F.format_string("a %d %% risk of staying open for a year", F.round(F.col("risk_score") * 100).cast("long"))),
    ))
    reason = F.when(~F.col("is_open"), "completed, no warning").when(F.size(parts) == 0, "no sign of stalling").otherwise(F.concat_ws(": ", "early_warning_level", F.array_join(parts, "; ")))
    return works.withColumn("early_warning_reason", reason)


def add_fusion(works: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Seven gated signals, noisy-or priority, corroborating families, band, exposure and audit return."""
    missing = sorted({"amount_pct", "amount_z", "open_duration_pct", "risk_score", "change_point", "anomaly_flag", "duplicate_similarity"} - set(works.columns))
    if missing:
        raise ValueError(f"signals without a column: {missing}")
    zero = F.lit(0.0)
    get = lambda c: F.coalesce(F.col(c).cast("double"), zero)
    conformance = F.least(reduce(lambda a, b: a + b, (is_true(F.col(c)).cast("double") for c in ("is_backdated", "completed_without_sanction", "is_future_dated", "is_orphan"))), F.lit(1.0))
    signals = {
        "peer_amount": F.when(F.col("amount_pct") >= config.percentile_gate, 1 / (1 + F.exp(-clip(F.col("amount_z") - 2, -6.0, 6.0)))).otherwise(0.0),
        "peer_duration": F.when(F.col("open_duration_pct") >= config.percentile_gate, F.col("open_duration_pct")).otherwise(0.0),
        "completion_risk": F.when(F.col("risk_score") >= config.risk_gate, F.col("risk_score")).otherwise(0.0),
        "conformance": 0.9 * conformance, "change_point": get("change_point"), "anomaly": get("anomaly_flag"),
        "duplicate": F.when(get("duplicate_similarity") >= config.duplicate_gate, get("duplicate_similarity")).otherwise(0.0),
    }
    works = works.withColumns({f"sig_{k}": v for k, v in signals.items()})
    left = reduce(lambda a, b: a * b, (1 - config.weights[k] * clip(F.col(f"sig_{k}")) for k in signals), F.lit(1.0))
    families = {f: [k for k in signals if config.families[k] == f] for f in dict.fromkeys(config.families.values())}
    n = reduce(lambda a, b: a + b, (reduce(lambda a, b: a | b, (F.col(f"sig_{k}") > 0 for k in ks)).cast("int") for ks in families.values()))
    works = works.withColumns({"priority": 1 - left, "n_families": n, "rs_exposure": F.coalesce("recommended_amount", zero) * clip(F.col("risk_score"))})
    band = F.when(F.col("n_families") == 0, "NONE").when(F.col("n_families") == 1, "LOW").when(F.col("n_families") == 2, "MEDIUM").otherwise("HIGH")
    return works.withColumns({"band": band, "audit_roi": F.col("priority") * F.col("rs_exposure") * (1 + F.col("n_families"))})


def suggested_actions() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("sig_duplicate") > 0, "compare with the matched work"), F.when(F.col("compliance_flags") > 0, "review the lifecycle record"), F.when(F.col("sig_peer_amount") > 0, "compare scope and estimate with peers"),
        F.when(F.col("early_warning_level").isin("HIGH", "CRITICAL"), "ask the agency for progress"), F.lit("verify documents and field evidence"),
    ))


def next_step() -> Column:
    return F.when(F.col("is_backdated") | F.col("completed_without_sanction") | F.col("is_future_dated"), "check lifecycle dates").when(F.col("sig_peer_amount") > 0, "verify estimate").when((F.col("sig_completion_risk") > 0) | (F.col("sig_peer_duration") > 0), "request progress").otherwise("review evidence")


def evidence(config: Config = CONFIG) -> Column:
    """One entry for each signal that fired."""
    percent = lambda c: F.round(F.col(c) * 100).cast("long")
    detail = {
        "peer_amount": F.format_string("amount at percentile %d of %d peers", percent("amount_pct"), F.col("peer_group_size")), "peer_duration": F.format_string("open longer than %d %% of open peers", percent("open_duration_pct")),
        "completion_risk": F.format_string("risk %d %% within %d days", percent("risk_score"), F.lit(config.horizon_days)), "conformance": F.lit("inconsistent lifecycle record"),
        "change_point": F.lit("the agency's yearly median moved"), "anomaly": F.lit("unusual amount and age"), "duplicate": F.lit("a near-identical work exists"),
    }
    return F.array_compact(F.array(*(F.when(F.col(f"sig_{k}") > 0, F.struct(F.lit(k).alias("signal"), F.lit(config.families[k]).alias("family"), v.alias("detail"))) for k, v in detail.items())))


def findings() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(f"chk_{k}"), F.struct(F.initcap(F.lit(k.replace("_", " "))).alias("check"), F.lit(a).alias("authority"), F.lit(s).alias("severity"))) for k, (a, s) in CHECKS.items())))


def case_files(scored: DataFrame) -> DataFrame:
    """Nested case files of the surfaced works (bands MEDIUM and HIGH)."""
    status = F.when(F.col("is_completed"), "Completed").when(F.col("is_sanctioned"), "Sanctioned").otherwise("Recommended")
    return scored.where(F.col("band").isin("MEDIUM", "HIGH")).select(
        "work_ref",
        F.struct("state_name", "constituency", "implementing_agency", "mp_name", "recommended_amount", F.substring("work_description", 1, 300).alias("description"), F.date_format("recommendation_date", "yyyy-MM-dd").alias("recommended_on"), status.alias("status")).alias("identity"),
        F.struct("peer_level", "peer_group_size", F.round("amount_pct", 3).alias("amount_percentile")).alias("peers"), F.struct(F.round("risk_score", 3).alias("completion_risk"), F.col("risk_level_used").alias("basis")).alias("risk"),
        F.round("rs_exposure", 0).alias("exposure"), F.round("priority", 4).alias("priority"), "band", "n_families", F.round("audit_roi", 0).alias("audit_roi"), evidence().alias("evidence"), findings().alias("findings"),
        F.struct(F.col("early_warning_level").alias("level"), F.round("early_warning_score", 3).alias("score"), F.col("early_warning_reason").alias("reason")).alias("early_warning"),
        next_step().alias("next_step"), suggested_actions().alias("actions"),
    )


GENESIS = "0" * 64


def chain_hash(columns: list[str], before: str = "prev_hash") -> Column:
    """The hash of a row of a log: of its columns and its predecessor's hash, as a JSON array."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*columns, before)))), 256)


def chain(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Add entry (1, 2, ... in a log), prev_hash and row_hash, by ``order`` within each ``key``.

    A hash needs the one before, so a log is walked by one task; it reads sorted rows as a stream and holds one batch, however long
    the log. Rows with equal ``order`` follow by their columns. Null cells are hashed as empty, a null key has a log of its own.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    rows = log.select(key, order, *cells)
    kinds = rows.schema
    rows = rows.withColumn("_open", F.to_json(F.array(*columns, F.lit(""))))
    rows = rows.repartition(key).sortWithinPartitions(key, order, *columns)

    def walk(batches):
        current, entry, last, started = None, 0, GENESIS, False
        for batch in batches:
            entries, before, hashes = [], [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not started or name != current:
                    current, entry, last, started = name, 0, GENESIS, True
                entry += 1
                entries.append(entry)
                before.append(last)
                last = sha256(f'{content[:-2]}{last}"]'.encode()).hexdigest()
                hashes.append(last)
            new = (pa.array(entries, pa.int64()), pa.array(before, pa.string()), pa.array(hashes, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*kinds.names, "entry", "prev_hash", "row_hash"])

    return rows.mapInArrow(walk, T.StructType([*kinds.fields, T.StructField("entry", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())]))


def first_break(chained: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, entries, valid, broken_at_seq, reason): the first row whose link or content doesn't hold; links are looked at first.

    Each row meets the entry before its own in a join on (key, entry), so one long log is verified by many tasks. A missing entry,
    or one that stands twice, breaks the link of its follower.
    """
    last = chained.groupBy(F.col(key).alias("_k"), (F.col("entry") + 1).alias("_e")).agg(F.count("*").alias("_n"), F.min("row_hash").alias("_last"))
    rows = chained.join(last, F.col(key).eqNullSafe(F.col("_k")) & (F.col("entry") == F.col("_e")), "left")
    before = F.when(F.col("entry") == 1, GENESIS).when(F.col("_n") == 1, F.col("_last"))
    reason = F.when(~F.col("prev_hash").eqNullSafe(before), "link").when(~F.col("row_hash").eqNullSafe(chain_hash(columns)), "content")
    rows = rows.withColumn("_reason", reason)
    first = F.min(F.when(F.col("_reason").isNotNull(), F.struct(F.col("entry"), F.col(order).alias("at"), "_reason")))
    out = rows.groupBy(key).agg(F.count("*").alias("entries"), first.alias("_first"))
    return out.select(key, "entries", F.col("_first").isNull().alias("valid"), F.col("_first.at").alias("broken_at_seq"), F.col("_first._reason").alias("reason"))
