"""The scored portfolio: one chain of column operators over the works view, and the same chain as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worksift.operators import fusion, model_store, peers, series, similarity
from worksift.plans import text_index
from worksift.plans.lineage import cleaned, cut, shared_folder, small, stored, together
from worksift.sources.adapters import WORKS_SQL, works


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.add_features(peers.add_category(works(spark, sf_dir)))


def compared(spark: SparkSession, sf_dir: str, min_peers: int | None = None) -> DataFrame:
    return peers.add_peers(featured(spark, sf_dir), min_peers=min_peers)


def score(base: DataFrame, risk: DataFrame | None = None, anomaly: DataFrame | None = None, texts: DataFrame | None = None, ranged: bool = False, at_hand: bool = False) -> DataFrame:
    """Category to early warning, for any rows in the shape of the works view: seven signals in six families.

    ``risk`` (work_ref, cox_risk) and ``anomaly`` (work_ref, anomaly_flag) are model tables. Without them the risk is Kaplan-Meier by
    category, and no work is flagged. ``texts`` (text_a, text_b, similarity) are similar descriptions. ``ranged`` rows come sorted by state and
    reference. All aggregates read one stored table of works, which rows ``at_hand`` with their features are; small tables are added last, so a
    work is shuffled once. What doesn't depend on another is made at once.
    """
    works_ = base if at_hand else stored(peers.add_features(peers.add_category(base)))
    add_peers, moved, duplicates, waits, km = together(
        base.sparkSession,
        lambda: peers.peer_columns(works_),
        lambda: small(cut(series.change_points(works_).select("implementing_agency", "change_point"))),
        lambda: stored(similarity.duplicate_signal(works_, texts)),
        lambda: fusion.completed_medians(works_),
        lambda: small(cut(peers.survival_risk(works_))) if risk is None else None,
    )
    tables = [duplicates]
    if risk is not None:
        tables.append(risk.select("work_ref", F.col("cox_risk").cast("double").alias("_cox")))
    if anomaly is not None:
        tables.append(anomaly.select("work_ref", F.col("anomaly_flag").cast("double").alias("_flag")))
    rows = _with_tables(works_, tables, ranged)
    if risk is None:
        rows = peers.add_risk(rows, km)
    else:
        rows = peers.with_risk(rows.withColumnRenamed("_cox", "_risk"))
    rows = add_peers(rows).join(moved, "implementing_agency", "left").na.fill(0.0, ["change_point"])
    rows = rows.withColumn("anomaly_flag", F.lit(0.0)) if anomaly is None else rows.withColumnRenamed("_flag", "anomaly_flag").na.fill(0.0, ["anomaly_flag"])
    rows = fusion.add_early_warning(fusion.add_fusion(fusion.add_checks(rows)), found=waits)
    return rows.sortWithinPartitions("state_name", "work_ref") if ranged else rows


def _with_tables(works_: DataFrame, tables: list[DataFrame], ranged: bool) -> DataFrame:
    """``works_`` with the columns of ``tables`` by (state_name, work_ref), or by work_ref where a table has no state."""
    if not ranged:
        for t in tables:
            works_ = works_.join(t.drop("state_name"), "work_ref", "left")
        return works_
    # Works and the rows that belong to them are dealt by one range shuffle; a window over each work brings them together.
    added = [f for t in tables for f in t.schema if f.name not in ("work_ref", "state_name")]
    parts = [works_.withColumn("_work", F.lit(True))]
    for t in tables:
        parts.append(t if "state_name" in t.columns else stored(t.join(works_.select("work_ref", "state_name").hint("merge"), "work_ref")))
    rows = parts[0]
    for t in parts[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    key = ["state_name", "work_ref"]
    one = Window.partitionBy(*key)
    rows = rows.repartitionByRange(*key).withColumns({f.name: F.first(f.name, ignorenulls=True).over(one) for f in added})
    return rows.where("_work").drop("_work")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(works(spark, sf_dir))


#: Stored tables of this session, by application, table folder and kind.
_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def _stored(spark: SparkSession, sf_dir: str, kind: str, make, by: tuple[str, ...] = ("state_name",)) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED:
        rows, path = make(), shared_folder(spark)
        with cleaned(spark):
            rows.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        _STORED[key] = (path, rows.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def stored_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works as a table, made once a session: models, scores and validation read it."""
    return _stored(spark, sf_dir, "works", lambda: works(spark, sf_dir), ())


def stored_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored portfolio as a table: made once a session, by state and sorted by reference; lookups and reports prune it.

    The tables below ``sf_dir`` are taken as unchanged until ``forget`` is called.
    """
    return _stored(spark, sf_dir, "scored", lambda: score(works(spark, sf_dir), ranged=True))


def stored_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    """The trigram index of the stored portfolio: made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "index")
    if key not in _STORED:
        path = shared_folder(spark)
        text_index.build(stored_scored(spark, sf_dir), path)
        _STORED[key] = (path, None)
    return text_index.TextIndex(spark, _STORED[key][0])


def stored_models(spark: SparkSession, sf_dir: str) -> model_store.Models:
    """Archetypes, Cox model and forest of the works: fitted and stored once a session, and always loaded from the store."""
    key = (spark.sparkContext.applicationId, sf_dir, "models")
    if key not in _STORED:
        path = shared_folder(spark)
        model_store.save(spark, model_store.train(stored_works(spark, sf_dir)), path)
        _STORED[key] = (path, None)
    return model_store.load(spark, _STORED[key][0])


def score_full(base: DataFrame, fitted: model_store.Models, ranged: bool = False, at_hand: bool = False) -> DataFrame:
    """All seven signals by fitted models, with each work's archetype. Rows ``at_hand`` are a table already."""
    named, risk, anomaly = model_store.apply(fitted, base, at_hand)
    return score(named, risk, anomaly, ranged=ranged, at_hand=True)


def stored_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio scored with the models, with its archetypes, as a stored table."""
    return _stored(spark, sf_dir, "full", lambda: score_full(stored_works(spark, sf_dir), stored_models(spark, sf_dir), ranged=True, at_hand=True))


def forget(sf_dir: str) -> None:
    """Score anew when ``sf_dir`` is asked for next."""
    for key in [k for k in _STORED if k[1] == sf_dir]:
        del _STORED[key]


FEATURES_SQL = (
    WORKS_SQL
    + r""",
feat AS (
  SELECT *, CASE WHEN d >= 0 THEN d::DOUBLE END AS duration_days FROM (
    SELECT *, coalesce(nullif(trim(regexp_extract(activity_name, '(?s)^WS/MP[^/]*/[^/]*/[^-/]*-(.*)$', 1)), ''), 'Uncategorised') AS activity_category,
      (is_completed AND NOT is_backdated AND NOT is_future_dated)::INT AS event_observed, ln(1 + recommended_amount) AS log_amount, NOT is_completed AS is_open,
      CASE WHEN is_completed AND NOT is_backdated AND NOT is_future_dated THEN completion_date - recommendation_date ELSE snapshot - recommendation_date END AS d
    FROM works))"""
)


def peers_sql(min_peers: int = 30) -> str:
    return (
        FEATURES_SQL
        + f""",
sizes AS (SELECT *, count(*) OVER (PARTITION BY activity_category, state_name) AS n0, count(*) OVER (PARTITION BY activity_category) AS n1, count(*) OVER (PARTITION BY state_name) AS n2, count(*) OVER () AS n3 FROM feat),
grp AS (
  SELECT *, CASE WHEN n0 >= {min_peers} THEN 'cat_state' WHEN n1 >= {min_peers} THEN 'cat' WHEN n2 >= {min_peers} THEN 'state' ELSE 'global' END AS peer_level,
    CASE WHEN n0 >= {min_peers} THEN 'cat_state:' || activity_category || '|' || state_name WHEN n1 >= {min_peers} THEN 'cat:' || activity_category WHEN n2 >= {min_peers} THEN 'state:' || state_name ELSE 'GLOBAL' END AS peer_group_id,
    CASE WHEN n0 >= {min_peers} THEN n0 WHEN n1 >= {min_peers} THEN n1 WHEN n2 >= {min_peers} THEN n2 ELSE n3 END AS peer_group_size FROM sizes),
pct AS (
  SELECT *, (rank() OVER (PARTITION BY peer_group_id ORDER BY recommended_amount) + (count(*) OVER (PARTITION BY peer_group_id, recommended_amount) - 1) / 2 - 1) / nullif(count(*) OVER (PARTITION BY peer_group_id) - 1, 0) AS amount_pct,
    CASE WHEN is_open AND duration_days IS NOT NULL THEN (rank() OVER (PARTITION BY peer_group_id, is_open, duration_days IS NULL ORDER BY duration_days) + (count(*) OVER (PARTITION BY peer_group_id, is_open, duration_days) - 1) / 2 - 1) / nullif(count(*) OVER (PARTITION BY peer_group_id, is_open) - 1, 0) END AS open_duration_pct,
    median(recommended_amount) OVER (PARTITION BY peer_group_id) AS med, quantile_cont(recommended_amount, 0.25) OVER (PARTITION BY peer_group_id) AS q1, quantile_cont(recommended_amount, 0.75) OVER (PARTITION BY peer_group_id) AS q3 FROM grp),
mads AS (SELECT *, 1.4826 * median(abs(recommended_amount - med)) OVER (PARTITION BY peer_group_id) AS mad FROM pct),
peers AS (SELECT *, CASE WHEN mad > 0 THEN (recommended_amount - med) / mad WHEN q3 > q1 THEN (recommended_amount - med) / ((q3 - q1) / 1.349) ELSE 0 END AS amount_z FROM mads)"""
    )


YEARS_SQL = """,
years AS (SELECT implementing_agency, year(recommendation_date) AS year, count(*) AS n, median(recommended_amount) AS med FROM works GROUP BY ALL HAVING count(*) >= 5),
moves AS (SELECT *, lag(year) OVER w AS year_before, lag(med) OVER w AS median_before FROM years WINDOW w AS (PARTITION BY implementing_agency ORDER BY year)),
moved AS (SELECT *, abs(med - median_before) / (median_before + 1e-9) AS m FROM moves WHERE year_before IS NOT NULL),
cp AS (SELECT implementing_agency, least(m, 1.0) AS change_point, year_before, median_before, year AS year_after, med AS median_after
  FROM (SELECT *, row_number() OVER (PARTITION BY implementing_agency ORDER BY m DESC, year) AS r FROM moved) WHERE r = 1 AND m > 0.5)"""

KM_SQL = """,
kd AS (SELECT activity_category, duration_days, sum(event_observed) AS d, count(*) AS n FROM feat WHERE duration_days IS NOT NULL GROUP BY ALL),
kr AS (SELECT *, sum(n) OVER (PARTITION BY activity_category ORDER BY duration_days DESC) AS at_risk FROM kd),
km AS (SELECT activity_category, CASE WHEN max((d = at_risk)::INT) = 1 THEN 1.0 ELSE 1 - exp(sum(CASE WHEN d = at_risk THEN 0 ELSE ln(1 - d / at_risk) END)) END AS km_risk FROM kr WHERE duration_days <= 365 GROUP BY activity_category)"""

#: Similar descriptions by brute force, the works that meet, and each work's best concerning pair.
PAIRS_SQL = r""",
tt AS (SELECT DISTINCT work_description AS t FROM feat WHERE work_description IS NOT NULL),
tk AS MATERIALIZED (
  SELECT t, word, count(*) AS tf FROM (SELECT t, unnest(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM tt) GROUP BY ALL),
td AS (SELECT word, ln((1 + (SELECT count(*) FROM tt)) / (1 + count(*))) + 1 AS idf FROM tk GROUP BY word),
tv AS MATERIALIZED (SELECT t, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM tk JOIN td USING (word)),
tb AS MATERIALIZED (SELECT DISTINCT state_name, activity_category, work_description AS t FROM feat),
tp AS MATERIALIZED (SELECT DISTINCT x.t AS t1, y.t AS t2 FROM tb x JOIN tb y ON x.state_name = y.state_name AND x.activity_category = y.activity_category AND x.t < y.t),
tx AS MATERIALIZED (SELECT t1, t2, word, w FROM tp JOIN tv ON t = t1),
ts AS MATERIALIZED (SELECT t1, t2, round(sum(tx.w * tv.w), 4) AS s FROM tx JOIN tv ON tv.t = t2 AND tv.word = tx.word GROUP BY ALL HAVING round(sum(tx.w * tv.w), 4) >= 0.86),
dr AS MATERIALIZED (
  SELECT work_ref, state_name, activity_category, work_description, implementing_agency, constituency, mp_name, recommended_amount AS amt,
    row_number() OVER (PARTITION BY state_name, activity_category, work_description ORDER BY recommended_amount, work_ref) AS r
  FROM feat WHERE work_description IS NOT NULL AND recommended_amount IS NOT NULL),
met AS (
  SELECT x.work_ref AS a, y.work_ref AS b, 1.0::DOUBLE AS s, abs(x.amt - y.amt) AS gap
  FROM dr x JOIN dr y ON x.state_name = y.state_name AND x.activity_category = y.activity_category AND x.work_description = y.work_description AND x.r <> y.r AND y.r BETWEEN x.r - 5 AND x.r + 5),
tq AS (SELECT t1, t2, s FROM ts UNION ALL SELECT t2, t1, s FROM ts),
pos AS MATERIALIZED (
  SELECT x.work_ref, q.t2, q.s, x.amt, x.state_name, x.activity_category, count(y.work_ref) FILTER (y.amt < x.amt) AS below
  FROM dr x JOIN tq q ON q.t1 = x.work_description JOIN dr y ON y.state_name = x.state_name AND y.activity_category = x.activity_category AND y.work_description = q.t2 GROUP BY ALL),
met2 AS (
  SELECT p.work_ref AS a, y.work_ref AS b, p.s, abs(p.amt - y.amt) AS gap
  FROM pos p JOIN dr y ON y.state_name = p.state_name AND y.activity_category = p.activity_category AND y.work_description = p.t2 AND y.r BETWEEN p.below - 4 AND p.below + 5),
dl AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) AS n FROM met
  UNION ALL SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, gap, b) AS n FROM met2),
wp AS MATERIALIZED (
  SELECT d.a, d.b, d.s AS similarity, x.amt AS ax, y.amt AS ay, x.state_name, x.implementing_agency = y.implementing_agency AS same_agency, x.constituency = y.constituency AS same_constituency,
    x.mp_name = y.mp_name AS same_mp, x.work_description = y.work_description AS identical_text,
    CASE WHEN d.s >= 0.995 THEN 'EXACT' WHEN d.s >= 0.97 THEN 'NEAR_EXACT' WHEN d.s >= 0.92 THEN 'HIGH_SIMILARITY' ELSE 'POSSIBLE_REPEAT' END AS classification,
    d.s >= 0.97 AND x.implementing_agency = y.implementing_agency AND abs(x.amt - y.amt) <= 0.02 * greatest(abs(x.amt), abs(y.amt), 1.0) AS concerning
  FROM dl d JOIN dr x ON x.work_ref = d.a JOIN dr y ON y.work_ref = d.b WHERE d.n <= 5 AND d.a < d.b),
ds AS (
  SELECT work_ref, max(similarity) AS duplicate_similarity, arg_min(partner, (-similarity, partner)) AS duplicate_partner
  FROM (SELECT a AS work_ref, b AS partner, similarity FROM wp WHERE concerning UNION ALL SELECT b, a, similarity FROM wp WHERE concerning) GROUP BY work_ref)"""

SCORED_SQL = (
    peers_sql()
    + YEARS_SQL
    + KM_SQL
    + PAIRS_SQL
    + """,
base AS (
  SELECT p.*, coalesce(ds.duplicate_similarity, 0) AS s7, coalesce(cp.change_point, 0) AS change_point, CASE WHEN is_completed THEN 0 ELSE least(greatest(coalesce(km_risk, 0), 0), 1) END AS risk_score
  FROM peers p LEFT JOIN cp USING (implementing_agency) LEFT JOIN km USING (activity_category) LEFT JOIN ds ON ds.work_ref = p.work_ref),
checks AS (
  SELECT *, completed_without_sanction AS c1, is_backdated AS c2, is_future_dated AS c3, is_orphan AS c4, has_nonpositive_amount AS c5, work_description IS NULL AS c6,
    coalesce(is_open AND open_duration_pct >= 0.99, false) AS c7, coalesce(amount_pct >= 0.99, false) AS c8 FROM base),
sig AS (
  SELECT *, c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT + c7::INT + c8::INT AS compliance_flags,
    CASE WHEN c1 OR c2 OR c4 THEN 'HIGH' WHEN c3 OR c5 OR c7 OR c8 THEN 'MEDIUM' WHEN c6 THEN 'LOW' ELSE 'NONE' END AS compliance_severity,
    CASE WHEN amount_pct >= 0.9 THEN 1 / (1 + exp(-least(greatest(amount_z - 2, -6), 6))) ELSE 0 END AS s1, CASE WHEN open_duration_pct >= 0.9 THEN open_duration_pct ELSE 0 END AS s2,
    CASE WHEN risk_score >= 0.6 THEN risk_score ELSE 0 END AS s3, CASE WHEN is_backdated OR completed_without_sanction OR is_future_dated OR is_orphan THEN 0.9 ELSE 0 END AS s4, change_point AS s5 FROM checks),
fused AS (
  SELECT *, 1 - (1 - 0.6 * s1) * (1 - 0.55 * s2) * (1 - 0.6 * s3) * (1 - 0.75 * s4) * (1 - 0.5 * s5) * (1 - 0.65 * s7) AS priority,
    (s1 > 0)::INT + (s2 > 0 OR s3 > 0)::INT + (s4 > 0)::INT + (s5 > 0)::INT + (s7 > 0)::INT AS n_families, recommended_amount * risk_score AS rs_exposure FROM sig),
pm AS (SELECT activity_category, state_name, median(duration_days) AS pm FROM feat WHERE is_completed GROUP BY ALL),
nm AS (SELECT CASE WHEN median(duration_days) = 0 THEN 400 ELSE median(duration_days) END AS nm FROM feat WHERE is_completed),
stall AS (
  SELECT f.*, CASE WHEN n_families = 0 THEN 'NONE' WHEN n_families = 1 THEN 'LOW' WHEN n_families = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS band, priority * rs_exposure * (1 + n_families) AS audit_roi,
    coalesce(pm, nm) AS peer_median_days, CASE WHEN is_open THEN duration_days / greatest(coalesce(pm, nm), 30) END AS stall_ratio FROM fused f LEFT JOIN pm USING (activity_category, state_name), nm),
warn AS (SELECT *, CASE WHEN is_open THEN least(greatest(0.6 * risk_score + 0.4 * least(greatest(coalesce(stall_ratio, 0) / 3, 0), 1), 0), 1) ELSE 0 END AS early_warning_score FROM stall),
scored AS (
  SELECT *, CASE WHEN NOT is_open THEN 'LOW' WHEN round(early_warning_score, 12) >= 0.75 AND coalesce(stall_ratio, 0) >= 2 THEN 'CRITICAL' WHEN round(early_warning_score, 12) >= 0.6 THEN 'HIGH' WHEN round(early_warning_score, 12) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS early_warning_level FROM warn)"""
)
