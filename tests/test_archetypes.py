"""Archetypes and stored models: what is learnt, what works carry, and that a second session scores equally without fitting."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from worksift.operators import archetypes, model_store, models, peers
from worksift.plans import search
from worksift.plans.scored import score_full, stored_full, stored_models
from worksift.sources.adapters import works

KINDS = {"road": ["cc road", "paving", "lane"], "school": ["school", "classroom", "roof"], "water": ["borewell", "pump", "tank"], "light": ["solar", "light", "pole"]}


@pytest.fixture(scope="module")
def described(spark):
    """Works of four kinds, each of which says the kind's words, a place and filler; copies, and descriptions without words."""
    rng = random.Random(3)
    rows = []
    for k in range(240):
        kind = list(KINDS)[k % 4]
        rows.append((f"W{k}", f"Providing {' '.join(KINDS[kind])} at ward no {rng.randrange(9)} near {kind} {rng.randrange(40)}", kind))
    rows += [(f"C{k}", rows[0][1], "road") for k in range(50)] + [("N1", None, None), ("N2", " -- ", None)]
    return spark.createDataFrame(rows, "work_ref string, work_description string, kind string")


def test_archetypes_are_the_kinds(spark, described):
    learnt = archetypes.learn(described, ks=(2, 4, 9))
    got = peers.add_archetypes(described, learnt.assigned, learnt.catalog).toPandas()
    assert len(got) == 292 and (got[got.kind.isna()].archetype_id == -1).all() and (got[got.kind.isna()].archetype_label == "Unassigned").all()
    named = got[got.kind.notna()]
    assert named.groupby("archetype_id").kind.nunique().max() == 1 and max(learnt.sweep, key=lambda x: x[1])[0] >= 4
    for kind, group in named.groupby("kind"):
        label = group.archetype_label.iloc[0]
        assert any(w in label for w in " ".join(KINDS[kind]).split()), (kind, label)
    catalog = learnt.catalog.toPandas()
    assert catalog.n_descriptions.sum() == described.where("kind is not null").select("work_description").distinct().count() and catalog.archetype_id.is_unique


def test_nothing_to_learn_and_few_descriptions(spark, described):
    with pytest.raises(ValueError, match="nothing to learn"):
        archetypes.learn(described.where("kind is null"))
    few = archetypes.learn(described.limit(3), ks=(20, 30))
    assert few.assigned.count() == 3


def test_labels_gloss_and_say_what_they_are(spark):
    terms = [(0, i, t) for i, t in enumerate(["ka nirman", "sadak", "nirman sadak", "gram"])] + [(1, i, t) for i, t in enumerate(["construction", "village"])] + [(2, i, t) for i, t in enumerate(["solar light", "pole", "construction"])]
    got = {r.g: r for r in models.cluster_labels(spark.createDataFrame(terms, "g int, rank int, term string"), "g").collect()}
    assert "road" in got[0].label and got[0].interpretable and "language" in got[0].note
    assert not got[1].interpretable and "construction" in got[1].label and "filler" in got[1].note
    assert got[2].label == "solar light / pole / construction" and got[2].note == ""


def test_a_group_is_described_by_a_bounded_sample(spark):
    rows = spark.createDataFrame([("g", f"common rare{k}") for k in range(50)], "g string, t string")
    assert models.class_terms(rows, "g", "t", top=200, min_df=1, per_group=10).where("term rlike '^rare[0-9]+$'").count() == 10


def test_class_terms_equal_plain_counts(spark, monkeypatch):
    """Tasks that add up and hand on after a few words count the same: pairs across stretches, groups without a word or a name, odd letters."""
    monkeypatch.setattr(models, "MOST_NEW", 3)
    monkeypatch.setattr(models, "MOST_KEPT", 5)
    rng = random.Random(5)
    words = ["road", "Straße", "ÉCOLE", "the", "x", "пруд", "pond2", "७८", "𐐷𐐷", "lamp"]
    rows = [(rng.choice(["a", "b", None]), rng.choice([" ", " - ", "\n", ", "]).join(rng.choices(words, k=rng.randrange(12)))) for _ in range(200)]
    rows += [("c", None), ("c", ""), ("d", " -- the x"), ("e", "lone"), ("a", "!road!road")]
    tf = Counter()
    for group, text in rows:
        said = [w for w in re.split(r"[^\w]+", (text or "").lower()) if len(w) > 1 and w not in models.STOPWORDS]
        tf.update((group, t) for t in said + [f"{a} {b}" for a, b in zip(said, said[1:], strict=False)])
    n, df, total = len({g for g, _ in tf} - {None}), Counter(t for _, t in tf), Counter()
    for (_, t), k in tf.items():
        total[t] += k
    want = []
    for group in ("a", "b", "e"):
        raw = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for (g, t), k in tf.items() if g == group and total[t] >= 3}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want += [(group, i, t, pytest.approx(-w, abs=2e-9)) for i, (w, t) in enumerate(sorted((-round(x / norm, 9), t) for t, x in raw.items())[:12], 1)]
    got = models.class_terms(spark.createDataFrame(rows, "g string, t string").repartition(3), "g", "t").orderBy("g", "rank").collect()
    assert [tuple(r) for r in got] == want and len(want) == 24


def test_class_terms_read_texts_once_and_no_group_is_dealt_whole(spark):
    """The texts were read once for each use of the counts, and all terms of a group went to one task."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(f"g{k % 2}", f"road lamp{k % 5} pond") for k in range(40)], "g string, t string").mapInPandas(count, "g string, t string")
    found = models.class_terms(rows, "g", "t")
    assert found.count() == 24 and read.value == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("12, Final") < plan.index("Exchange hashpartitioning(g") < plan.index("12, Partial")


def test_a_second_session_scores_equally_without_fitting(spark, sf, tmp_path, monkeypatch):
    base = works(spark, sf).limit(2000)
    fitted = model_store.train(base, ks=(3, 6), trees=20)
    path = str(tmp_path / "store")
    assert model_store.versions(spark, path) == []
    with pytest.raises(LookupError):
        model_store.load(spark, path)
    assert [model_store.save(spark, fitted, path), model_store.save(spark, fitted, path)] == [1, 2] and model_store.versions(spark, path) == [1, 2]
    for name in ("fit_cox", "grow_forest", "fit_clusters", "survival_levels"):
        monkeypatch.setattr(models, name, lambda *a, **k: pytest.fail("it fits"))
    loaded = model_store.load(spark.newSession(), path, 1)
    assert loaded.cox == fitted.cox and loaded.forest.limit == fitted.forest.limit and loaded.archetypes.sweep == fitted.archetypes.sweep
    show = lambda found: [sorted(map(tuple, x.collect())) for x in (found[0].select("work_ref", "archetype_id", "archetype_label"), *found[1:])]
    assert show(model_store.apply(loaded, base)) == show(model_store.apply(fitted, base))
    new = base.limit(5).withColumn("work_description", F.concat("work_description", F.lit(" anew")))
    assert model_store.apply(loaded, new)[0].where("archetype_id >= 0").count() == 5


def test_the_served_portfolio_carries_archetypes_and_profiles_group_by_them(spark, sf):
    rows = stored_full(spark, sf).toPandas()
    assert (rows.archetype_id >= 0).all() and rows.archetype_label.nunique() > 3 and (rows.anomaly_flag > 0).any()
    got = archetypes.profiles(stored_full(spark, sf)).toPandas().set_index("archetype_label").sort_index()
    by = rows.groupby("archetype_label")
    want = pd.DataFrame({"n_works": by.size(), "states": by.state_name.nunique(), "agencies": by.implementing_agency.nunique(), "median_amount": by.recommended_amount.median().round(4)})
    want["completion_rate"] = by.is_completed.mean().round(6)
    want["median_days"] = rows[rows.is_completed].groupby("archetype_label").duration_days.median().round(4)
    want["lead_rate"] = by.band.agg(lambda b: b.isin(["MEDIUM", "HIGH"]).mean()).round(6)
    want["top_state"] = by.state_name.agg(lambda s: s.value_counts().sort_index().idxmax())
    pd.testing.assert_frame_equal(got[sorted(want)], want.sort_index()[sorted(want)], check_dtype=False)
    label = rows.archetype_label.iloc[0]
    word = label.split()[0].lower()
    assert search.search(stored_full(spark, sf), f"find all construction of {word}").count() >= (rows.archetype_label == label).sum() > 0
    assert stored_models(spark, sf).cox.levels.keys() == {"state_name", "archetype_label"}


def test_planted_works_are_rescored_with_all_signals(spark, sf):
    base = works(spark, sf).limit(500)
    rows = score_full(base, stored_models(spark, sf))
    assert rows.count() == 500 and rows.where("sig_anomaly > 0").count() > 0 and rows.where("risk_level_used = 'model'").count() > 0
