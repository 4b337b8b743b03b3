"""Golden cases on literal tables, and invariants on the small tables."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worksift.config import CONFIG
from worksift.functions import text as tx
from worksift.operators import fusion, models, peers, series, similarity
from worksift.plans import search
from worksift.plans.queries import QUERIES, SQL
from worksift.plans.scored import scored, stored_full
from worksift.sources import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("score,name", [(0.999, "EXACT"), (0.98, "NEAR_EXACT"), (0.93, "HIGH_SIMILARITY"), (0.87, "POSSIBLE_REPEAT"), (0.5, "NORMAL")])
def test_similarity_bands(spark, score, name):
    assert one(spark, similarity.classify(F.lit(score))) == name


@pytest.mark.parametrize("text", ["MP3018356-W86316", "MP 3018356 - W 86316", "mp3018356–w86316", "Work No. MP3O18356-W863I6 (board)"])
def test_references_are_read(spark, text):
    assert one(spark, tx.reference(F.lit(text))) == "MP3018356-W86316"


def test_no_reference(spark):
    assert one(spark, tx.reference(F.lit("Outdoor gym, Saran district"))) is None


@pytest.mark.parametrize("number,unit,value", [("6,50,00,000", None, 65e6), ("6.5", "Cr", 65e6), ("650", "lakh", 65e6), ("650", "lac", 65e6), ("65000", None, 65000.0), ("six lakh", None, None)])
def test_amounts(spark, number, unit, value):
    assert one(spark, tx.amount_value(F.lit(number), F.lit(unit).cast("string"))) == value


def test_amount_unit_needs_a_word_boundary(spark):
    assert one(spark, tx.amount(F.lit("Rs 500 land"))) == 500.0


@pytest.mark.parametrize("values,names", [([1, 2, 3], {"INSUFFICIENT_HISTORY"}), ([10] * 8 + [45, 47, 46], {"SUDDEN_CHANGE", "PERSISTENT_CHANGE"}), ([10, 11, 10, 9, 10, 11, 10, 10, 9], {"NORMAL"})])
def test_series_classes(spark, values, names):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    assert series.classify(rows, "k", "i", "v").first()["classification"] in names


def test_percentile_and_z_match_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"i": range(200), "g": rng.integers(0, 7, 200), "v": np.where(rng.random(200) < 0.1, np.nan, rng.integers(0, 15, 200))})
    frame.loc[frame.g == 6, "v"] = 5.0
    rows = spark.createDataFrame([(int(i), int(g), None if np.isnan(v) else float(v)) for i, g, v in frame.itertuples(index=False)], "i int, g int, v double")
    got = rows.join(peers.percentiles(rows, "v", ["g"], "p"), ["g", "v"], "left").join(peers.spreads(rows, "v", "g"), "g", "left").withColumn("z", peers.robust_z("v")).toPandas().sort_values("i")

    def z(x):
        med = x.median()
        scale = 1.4826 * (x - med).abs().median()
        scale = scale if scale > 0 else (x.quantile(0.75) - x.quantile(0.25)) / 1.349
        return (x - med) / scale if scale > 0 else x * 0 + 0.0

    want = frame.groupby("g").v.transform(lambda x: (x.rank() - 1) / (len(x) - 1))
    np.testing.assert_allclose(got.p.astype(float), want, equal_nan=True)
    ok = frame.v.notna()
    np.testing.assert_allclose(got.z.astype(float)[ok.values], frame.groupby("g").v.transform(z)[ok], atol=1e-9)


def test_guard():
    assert ingest.guard_rows("x", 10, 10) == 0 and ingest.guard_rows("x", 10, 4, "orphans") == 6
    with pytest.raises(ValueError):
        ingest.guard_rows("x", 10, 4)


def test_log_refuses_unknown_outcomes(spark, tmp_path):
    rows = spark.createDataFrame([("W1", "seen"), ("W2", "absent")], "work_ref string, outcome string")
    for _ in range(2):
        ingest.append_log(rows, str(tmp_path / "log"), ["seen", "absent"])
    for wrong in ("other", None):
        with pytest.raises(Exception, match="unknown outcome"):
            ingest.append_log(rows.unionByName(spark.createDataFrame([("W3", wrong)], rows.schema)), str(tmp_path / "log"), ["seen", "absent"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_rows_of_split_files_are_numbered(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 1), ("c", 3000)):
        (tmp_path / f"{name}.csv").write_text("house,mp_id\n" + "".join(f"LS,{k}\n" for k in range(n)))
    with_splits = ("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set(*with_splits)
    try:
        rows = ingest.read_export(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset(with_splits[0])
    assert len(rows) == 8001 and (rows["mp_id"].astype(int) == rows["raw_row_index"]).all()


@pytest.mark.parametrize("text,shown", [(" a lead ", "a lead"), ("Guilty!", ""), ("no CORRUPTED file", ""), ("guiltyish", "guiltyish"), (None, None)])
def test_wording_guard(spark, text, shown):
    assert one(spark, tx.guarded(F.lit(text).cast("string"))) == shown


def test_archetypes_keep_works_without_a_cluster(spark):
    works = spark.createDataFrame([("W1", "road"), ("W2", "well"), ("W3", None), ("W4", "hall")], "work_ref string, work_description string")
    assigned = spark.createDataFrame([("road", 1), ("hall", 2)], "work_description string, archetype_id int")
    catalog = spark.createDataFrame([(1, "Roads")], "archetype_id int, archetype_label string")
    got = {r.work_ref: (r.archetype_id, r.archetype_label) for r in peers.add_archetypes(works, assigned, catalog).collect()}
    assert got == {"W1": (1, "Roads"), "W2": (-1, "Unassigned"), "W3": (-1, "Unassigned"), "W4": (2, "Unassigned")}


def test_csv_contract(spark, tmp_path):
    good, bad, stage = (tmp_path / n for n in ("good.csv", "bad.csv", "stage.csv"))
    good.write_text("house,mp_id,tile_label,WORK_RECOMMENDATION_DTL_ID,RECOMMENDATION_DATE,RECOMMENDED_AMOUNT\nLS,7,Works Recommended,1,05-Mar-2024,10.5\nLS,7,Works Recommended,2,2024-03-05,ten\nLS,7,Works Recommended,,,\n")
    bad.write_text("house,unheard_of\nLS,1\n")
    stage.write_text("house,mp_id,tile_label\nLS,7,Works Dreamt\n")
    stages, totals = ingest.split_grains(ingest.load_raw(spark, [str(good)]))
    rows = {r.work_ref: r for r in stages.collect()}
    assert rows["MP7-W1"].recommendation_date == dt.date(2024, 3, 5) and rows["MP7-W2"].bad_cells == 2 and totals.count() == 1
    with pytest.raises(ValueError, match="unheard_of"):
        ingest.load_raw(spark, [str(bad)])
    with pytest.raises(Exception, match="unmapped stage"):
        ingest.load_raw(spark, [str(stage)]).collect()


def test_scope_refuses(spark):
    rows = spark.createDataFrame([("Bihar",), ("Kerala",)], "state_name string")
    assert search.visible(rows, "state", "Bihar").count() == 1
    assert search.visible(rows, "state", None).count() == 0 and search.visible(rows, "stranger", "Bihar").count() == 0 and search.visible(rows, "national", None).count() == 2


def test_hamming_pairs_are_exact(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)]
    prints = base + [b ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for b in base] + base[:5]
    rows = spark.createDataFrame(list(enumerate(prints)), "k long, s long")
    got = {(r.a, r.b): r.distance for r in similarity.hamming_pairs(rows, "k", "s", 8).collect()}
    first = {}
    for k, s in enumerate(prints):
        first.setdefault(s, k)
    keys = sorted((k, s) for s, k in first.items())
    count = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert got == {(a, b): count(x, y) for a, x in keys for b, y in keys if a < b and count(x, y) <= 8}


@pytest.mark.parametrize("most", [0, 2, 8, 14])
def test_hamming_pairs_differ_in_every_chunk_but_one(spark, most):
    """Chunks of rounded-up size left out those beyond bit 64, and so pairs that differ once in each of the others."""
    size = -(-64 // (most + 1))
    flips = [low for low in range(0, 64, size)][:most]
    flips += [x for x in range(64) if x not in flips][: most - len(flips)]
    other = sum(1 << x for x in flips)
    rows = spark.createDataFrame([(1, 0), (2, other - (1 << 64) if other >> 63 else other)], "k long, s long")
    got = [tuple(r) for r in similarity.hamming_pairs(rows, "k", "s", most).collect()]
    assert got == ([(1, 2, most)] if most else [])


def test_signatures_of_many_blocks_meet_without_candidate_keys(spark, monkeypatch):
    """No row is exploded into keys, which were broadcast by the size of the rows they came from."""
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)]
    prints += [p ^ sum(1 << int(i) for i in set(rng.integers(0, 63, 14))) for p in prints]
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 50)
    got = similarity.hamming_pairs(spark.createDataFrame(list(enumerate(prints)), "k long, s long"), "k", "s", 14)
    count = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert sorted(map(tuple, got.collect())) == [(a, b, count(prints[a], prints[b])) for a in range(600) for b in range(a + 1, 600) if count(prints[a], prints[b]) <= 14]
    assert "combinations" not in vars(similarity)


def test_simhash_is_the_majority_of_the_words_hashes(spark):
    texts = ["one two  three\tfour", "a A b", "", None, "alone"]
    rows = similarity.with_simhash(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, text string"), "text", "sig")
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for x in texts if x for w in x.lower().split()], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    want = []
    for x in texts:
        words = set((x or "").lower().split())
        value = sum(1 << i for i in range(64) if sum(1 if hashes[w] >> i & 1 else -1 for w in words) > 0)
        want.append(value - (1 << 64) if value >> 63 else value)
    assert [r.sig for r in rows.orderBy("k").collect()] == want
    assert len(rows._jdf.queryExecution().toString()) < 20_000


def test_greedy_clusters_of_fingerprints(spark):
    """Each row joins the first cluster whose head is near, taken in order, against a loop over rows."""
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64)]
    for _ in range(100):
        x = prints[int(rng.integers(len(prints)))]
        for i in rng.integers(0, 63, int(rng.integers(0, 12))):
            x ^= 1 << int(i)
        prints.append(x)
    rows = [(k, s, f"w{k % 7}") for k, s in enumerate(prints)] + [(500 + k, prints[3], "w9") for k in range(5)] + [(900, None, "w1")]
    count = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    clusters, first = [], {}
    for k, s, w in sorted(rows, key=lambda r: r[0]):
        if s is None:
            continue
        first.setdefault(s, k)
    heads = {}
    for s, k in sorted(first.items(), key=lambda x: x[1]):
        near = [c for c in clusters if count(s, c[0]) <= 14]
        if near:
            heads[s] = near[0]
        else:
            clusters.append((s, k))
            heads[s] = clusters[-1]
    want = {}
    for k, s, w in rows:
        if s is not None:
            c = want.setdefault(heads[s][1], [0, set(), set(), 99])
            c[0] += 1
            c[1].add(w)
            c[2].add(s)
            c[3] = min(c[3], 0 if heads[s][0] == s else count(s, heads[s][0]))
    got = {r["head"]: (r.uses, r.sources, r.signatures) for r in similarity.reuse_report(spark.createDataFrame(rows, "k long, s long, w string"), "k", "s", "w").collect()}
    assert got == {h: (n, len(w), len(s)) for h, (n, w, s, _) in want.items() if n > 1}


def test_work_pairs_and_signal(spark):
    rng = np.random.default_rng(6)
    rows = [(f"W{k:03d}", "S", "C", f"text {k % 4}" if k % 9 else None, f"A{k % 3}", "c", "m", float(rng.integers(100, 400))) for k in range(120)]
    works = spark.createDataFrame(rows, "work_ref string, state_name string, activity_category string, work_description string, implementing_agency string, constituency string, mp_name string, recommended_amount double")
    texts = spark.createDataFrame([("text 0", "text 1", 0.98), ("text 2", "text 3", 0.9)], "text_a string, text_b string, similarity double")
    got = {(r.a, r.b): r for r in similarity.work_pairs(works, texts).collect()}
    want = {}
    for x in rows:
        same = sorted((abs(x[7] - y[7]), y[0]) for y in rows if y[0] != x[0] and x[3] and y[3] == x[3])[:5]
        want |= {(x[0], y): 1.0 for _, y in same if x[0] < y}
        for pair, s in ((("text 0", "text 1"), 0.98), (("text 2", "text 3"), 0.9)):
            if x[3] in pair:
                other = pair[1 - pair.index(x[3])]
                want |= {(x[0], y): s for _, y in sorted((abs(x[7] - y[7]), y[0]) for y in rows if y[3] == other)[:5] if x[0] < y}
    assert {k: r.similarity for k, r in got.items()} == want
    by = {r[0]: r for r in rows}
    best = {}
    for (a, b), s in want.items():
        if s >= 0.97 and by[a][4] == by[b][4] and abs(by[a][7] - by[b][7]) <= 0.02 * max(by[a][7], by[b][7]):
            for x, y in ((a, b), (b, a)):
                best[x] = min(best.get(x, (0, "")), (-s, y))
    assert {r.work_ref: (-r.duplicate_similarity, r.duplicate_partner) for r in similarity.duplicate_signal(works, texts).collect()} == best


def test_works_of_one_description_meet_at_the_ends_of_stretches(spark, monkeypatch):
    """Each lists its nearest by amount, also beyond the stretch it is dealt to; no pair is shuffled."""
    monkeypatch.setattr(similarity, "STRETCH", 12)
    rng = np.random.default_rng(3)
    works = [(f"R{k:03}", "S", "C", "text", float(rng.integers(0, 400))) for k in range(100)]
    numbered = similarity.by_amount(spark.createDataFrame(works, "work_ref string, state_name string, activity_category string, work_description string, recommended_amount double"))
    met = similarity.same_text_neighbours(numbered, 5)
    order, want = sorted((w[4], w[0]) for w in works), set()
    for i, (amount, x) in enumerate(order):
        near = sorted((abs(a - amount), y) for a, y in order[max(0, i - 5) : i + 6] if y != x)[:5]
        want |= {(x, y) for _, y in near if x < y}
    assert {(r.a, r.b) for r in met.collect()} == want
    assert "Join" not in similarity.same_text_neighbours(numbered.limit(9), 5)._jdf.queryExecution().optimizedPlan().toString()


def test_early_warning_reads_durations_from_the_table_at_hand(spark):
    from worksift.operators import fusion

    rows = spark.createDataFrame([("C", "S", 40.0, True, False, 0.0), ("C", "S", 90.0, False, True, 0.7)], "activity_category string, state_name string, duration_days double, is_completed boolean, is_open boolean, risk_score double")
    both = [fusion.add_early_warning(rows, d).select("stall_ratio", "early_warning_score", "early_warning_level").orderBy("stall_ratio").collect() for d in (None, rows)]
    assert both[0] == both[1] and both[0][1].stall_ratio == 90 / 40


def test_chain_finds_the_first_break(spark):
    rows = spark.createDataFrame([(w, k, f"a{k}") for w in ("x", "y", "z") for k in range(1, 6)], "w string, seq int, detail string")
    chained = fusion.chain(rows, "w", "seq", ["detail"])
    hit = chained.withColumn("detail", F.when(F.expr("seq = 3 and w <> 'z'"), "changed").otherwise(F.col("detail")))
    hit = hit.withColumn("row_hash", F.when(F.expr("seq = 3 and w = 'y'"), fusion.chain_hash(["detail"])).otherwise(F.col("row_hash")))
    got = {r.w: (r.entries, r.valid, r.broken_at_seq, r.reason) for r in fusion.first_break(hit, "w", "seq", ["detail"]).collect()}
    assert got == {"x": (5, False, 3, "content"), "y": (5, False, 4, "link"), "z": (5, True, None, None)}


def test_full_score_fuses_seven_signals(spark, sf):
    rows = stored_full(spark, sf).toPandas()
    left = np.ones(len(rows))
    for k, w in CONFIG.weights.items():
        left *= 1 - w * rows[f"sig_{k}"].clip(0, 1)
    families = {f: [k for k in CONFIG.weights if CONFIG.families[k] == f] for f in CONFIG.families.values()}
    np.testing.assert_allclose(rows["priority"], 1 - left, atol=1e-9)
    assert (rows["n_families"] == sum((rows[[f"sig_{k}" for k in ks]] > 0).any(axis=1).astype(int) for ks in families.values())).all()
    assert (rows["sig_anomaly"] > 0).any() and (rows["sig_duplicate"] > 0).any()
    with pytest.raises(ValueError, match="anomaly_flag"):
        fusion.add_fusion(spark.createDataFrame([(1,)], "amount_pct int"))


def test_validation_detects_what_was_planted(spark, sf):
    got = {r.perturbation: r for r in QUERIES["v1_v5_validation"](spark, sf).collect()}
    assert got["overall"].planted == sum(r.planted for k, r in got.items() if k != "overall") and got["clone_description"].detected_rate is not None


def test_profile_without_a_cap_counts_all(spark):
    from worksift.sources import ingest

    got = ingest.profile(spark.range(260_000).withColumnRenamed("id", "k"), cap=None).first()
    assert (got.n_distinct, got.capped) == (260_000, False)
    assert ingest.profile(spark.range(260_000)).first().capped


def test_a_record_is_matched_once_and_by_its_whole_reference(spark, tmp_path):
    """Keys of seven digits were cut to six, and references that then were equal gave a record several rows."""
    from worksift.plans.queries import QUERIES

    orders = spark.createDataFrame([(1_234_561, 1, 500.0), (1_234_562, 1, 700.0), (1_234_565, 1, 900.0)], "o_orderkey long, o_custkey long, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.matched, r.amount_agrees) for r in QUERIES["c12_match_records"](spark, str(tmp_path)).collect()}
    assert got == {1_234_561: (True, True), 1_234_562: (True, True), 1_234_565: (False, False)}
    records, known = spark.createDataFrame([("R1", 700.0)], "ref string, amount double"), spark.createDataFrame([("R1", 10.0), ("R1", 700.0)], "known string, known_amount double")
    assert [(r.matched, r.amount_agrees) for r in similarity.match_records(records, known).collect()] == [(True, True)]


def test_masks_of_references_are_not_broadcast(spark):
    """The sides' sizes were taken from tables that are exploded into a row for each digit."""
    rows = spark.createDataFrame([("MP0000001-W12",), ("MP0000001-W13",)], "ref string")
    plan = similarity.near_references(rows, rows.withColumnRenamed("ref", "known"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_near_references(spark):
    rows = spark.createDataFrame([("MP1-W23",)], "ref string")
    known = spark.createDataFrame([("MP1-W24",), ("MP1-W23",), ("MP2-W24",), ("MP9-W23",)], "known string")
    assert similarity.near_references(rows, known).first()["near"] == ["MP1-W24", "MP9-W23"]


def test_cluster_labels(spark):
    terms = [(0, i, t) for i, t in enumerate(["lai", "ke", "lai ki", "solar light", "solar"])] + [(1, i, t) for i, t in enumerate(["hall", "community hall", "community", "mandap"])] + [(2, i, t) for i, t in enumerate(["ke", "ki", "ka", "se", "mein"])]
    got = {r.g: r for r in models.cluster_labels(spark.createDataFrame(terms, "g int, rank int, term string"), "g").collect()}
    assert "solar" in got[0].label and "lai" not in got[0].label and got[0].interpretable
    assert got[1].label.count("hall") == 1 and not got[2].interpretable


def test_cox_recovers_planted_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    t = np.ceil(rng.exponential(300 / np.exp(x @ [0.7, -0.4]))).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"duration_days": np.minimum(t, 600), "event_observed": (t < 600).astype(int), "a": x[:, 0], "b": x[:, 1]}))
    beta, baseline = models.cox(rows, ["a", "b"])
    assert np.allclose(beta, [0.7, -0.4], atol=0.08) and 0 < models.survival_at(baseline, 300.5) < 1


def test_isolation_forest_finds_the_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(490, 2)), rng.normal(12, 1, size=(10, 2))])
    rows = spark.createDataFrame(pd.DataFrame({"k": range(500), "a": x[:, 0], "b": x[:, 1]}))
    flagged = {r.k for r in models.isolation_forest(rows, "k", ["a", "b"], trees=30).where("anomaly_flag = 1").collect()}
    assert len(flagged & set(range(490, 500))) >= 9


def test_portfolio_invariants(spark, sf):
    rows = scored(spark, sf).cache()
    assert rows.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert rows.where("band in ('MEDIUM', 'HIGH') and n_families < 2").count() == 0
    assert rows.where("rs_exposure > recommended_amount + 1e-6 or priority < 0 or priority >= 1").count() == 0


@pytest.mark.parametrize("name", ["flagship_top_outliers", "e7_d14_change_points", "d6_warning_summary", "c6_e12_a8_neighbours", "k2_live_counters"])
def test_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(SQL[name]).df()[list(got.columns)]
    show = lambda df: sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))
    assert show(got) == show(want)


def test_partners_of_one_description_meet_across_ranges(spark, monkeypatch):
    """The score's duplicates equal the pair table's, over ranges of a few rows and batches that end anywhere; no pair is shuffled."""
    rng = np.random.default_rng(8)
    rows = [(f"R{k:04}", "S", "C" if k % 50 else None, f"text {k % 7 // 5}" if k % 11 else None, f"A{k % 3}" if k % 13 else None, "c", "m", float(rng.integers(0, 60)) if k % 17 else None) for k in range(700)]
    works = spark.createDataFrame(rows, "work_ref string, state_name string, activity_category string, work_description string, implementing_agency string, constituency string, mp_name string, recommended_amount double")
    none = spark.createDataFrame([], "text_a string, text_b string, similarity double")
    pairs = similarity.work_pairs(works, none)
    want = {tuple(r) for r in similarity.best_partner(pairs.where(similarity.concerning(pairs))).select("ref", "partner", "similarity").collect()}
    assert len(want) > 300
    try:
        for ranges, batch in ((1, 7), (3, 1000), (90, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            found = similarity.same_text_partners(works)
            assert {(r.work_ref, r.duplicate_partner, r.duplicate_similarity) for r in found.collect()} == want
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_stored_work_is_shuffled_once(spark, sf):
    """Works and what belongs to them are dealt by one range shuffle, and peers' percentiles are added without one."""
    from worksift.plans.scored import score
    from worksift.sources.adapters import works

    rows = score(works(spark, sf), ranged=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    plain = score(works(spark, sf)).select(*rows.columns)
    assert rows.count() == plain.count() and rows.exceptAll(plain).isEmpty()


def test_cox_passes_read_each_different_row_once(spark, monkeypatch):
    """Copies are one row with their count: twenty copies and twenty times the ridge fit what one copy fits."""
    rng = np.random.default_rng(1)
    one = pd.DataFrame({"duration_days": rng.integers(1, 40, 300).astype(float), "event_observed": rng.integers(0, 2, 300), "a": rng.normal(size=300)})
    whole, sizes, cut = spark.createDataFrame(one), [], models.cut
    monkeypatch.setattr(models, "cut", lambda df: sizes.append(df.count()) or cut(df))
    fitted = [models.cox(rows, ["a"], ridge) for rows, ridge in ((whole, 0.1), (whole.crossJoin(spark.range(20)).drop("id"), 2.0))]
    assert sizes == [300, 300] and np.allclose(fitted[0][0], fitted[1][0], atol=1e-9)
    assert np.allclose(*(models.survival_at(baseline, 20) for _, baseline in fitted))


def test_forest_scores_rows_of_equal_values_once(spark):
    rng = np.random.default_rng(2)
    values = pd.DataFrame({"k": range(600), "a": rng.integers(0, 30, 600) / 4, "b": rng.integers(0, 3, 600).astype(float)})
    rows = spark.createDataFrame(values)
    forest = models.grow_forest(rows, "k", ["a", "b"], trees=12, sample=64)
    trees = [g.set_index("node") for _, g in forest.nodes.groupby("tree")]

    def path(tree, row):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] if row[["a", "b"][tree.feature[at]]] < tree.value[at] else tree.right[at]
        return tree.path[at]

    scored = forest.scores(rows, "k")
    assert "MapInPandas" not in scored._jdf.queryExecution().executedPlan().toString()  # different values are scored before, as a small table
    got = {r.k: r.score for r in scored.collect()}
    assert len(got) == 600 and all(np.isclose(got[r["k"]], 2 ** (-sum(path(t, r) for t in trees) / 12 / forest.scale)) for _, r in values.iloc[:150].iterrows())


def test_forest_limit_does_not_move_with_the_partitions(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"k": range(40_000), "a": rng.normal(size=40_000)}))
    forests = [models.grow_forest(rows.repartition(n), "k", ["a"], trees=5, sample=64) for n in (1, 7)]
    scores = np.sort(forests[0].scores(rows, "k").toPandas()["score"].to_numpy())
    assert forests[0].limit == forests[1].limit == scores[int(np.ceil(0.98 * len(scores))) - 1]


def test_the_duplicate_signal_agrees_with_its_sql(spark, sf):
    test_queries_agree_with_sql(spark, sf, "c7_duplicate_signal")


def test_the_silhouette_is_of_all_rows(spark, monkeypatch):
    """It was taken from a sample of 20,000 rows, so the count of groups was chosen by a part of them."""
    seen = []

    class Counting(models.ClusteringEvaluator):
        def evaluate(self, found):
            seen.append(found.count())
            return super().evaluate(found)

    monkeypatch.setattr(models, "ClusteringEvaluator", Counting)
    vectors = spark.range(40_100).select(F.col("id"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"))
    got = models.cluster(vectors, "id", "v", ks=(2, 3)).select("k", "silhouette").distinct()
    assert seen == [40_100, 40_100] and got.select("silhouette").distinct().count() == 1 and got.first().silhouette > 0.99


def test_works_are_not_made_by_one_task(spark, sf):
    """By the size of its compressed file the whole table of orders was broadcast, and one task made all works."""
    from worksift.sources.adapters import works

    plan = works(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin [o_orderkey" in plan


def test_materialising_leaves_no_shuffle_files_and_no_setting(spark):
    """Shuffle files stayed until the driver's garbage was collected, so all of a query's shuffles lay on disk at once."""
    from worksift.plans import lineage

    before, seen = spark.conf.get(lineage.CLEANS), []
    rows = lineage.cut(spark.range(1000).repartition(3, "id"))
    assert rows.count() == 1000 and spark.conf.get(lineage.CLEANS) == before
    got = lineage.together(spark, lambda: lineage.cut(rows.groupBy((rows.id % 7).alias("k")).count()).count(), lambda: lineage.stored(rows.distinct()).count())
    with lineage.cleaned(spark), lineage.cleaned(spark):
        seen.append(spark.conf.get(lineage.CLEANS))
    assert got == [7, 1000] and seen == ["true"] and spark.conf.get(lineage.CLEANS) == before


def test_pairs_are_stored_before_their_works_are_added(spark, sf):
    """All shuffles that make the pairs lay on disk beside those that add their works and sort them."""
    from worksift.plans.scored import featured

    plan = similarity.work_pairs(featured(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("SortMergeJoin") == 2
