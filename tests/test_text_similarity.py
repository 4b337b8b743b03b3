"""The similarity join of descriptions against brute force."""

import collections
import itertools
import math
import random
import re

import pytest

from worksift.operators import text_similarity

SCHEMA = "block string, text string, key string, word string"


def cosines(rows, least):
    """Every pair of different texts of a block, compared by the definition."""
    texts = sorted({t for _, t in rows if t is not None})
    counts = {t: collections.Counter(re.findall(r"[^\W_]+", t.lower())) for t in texts}
    held = collections.Counter(w for c in counts.values() for w in c)
    vectors = {}
    for t, c in counts.items():
        raw = {w: n * (math.log((1 + len(texts)) / (1 + held[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors[t] = {w: v / norm for w, v in raw.items()}
    blocks = collections.defaultdict(set)
    for b, t in rows:
        if b is not None and t is not None:
            blocks[b].add(t)
    pairs = {p for group in blocks.values() for p in itertools.combinations(sorted(group), 2)}
    found = {p: round(sum(v * vectors[p[1]].get(w, 0) for w, v in vectors[p[0]].items()), 4) for p in pairs}
    return {p: s for p, s in found.items() if s >= least}


@pytest.mark.parametrize("least", [0.3, 0.6, 0.86, 0.97])
def test_similar_texts_equal_brute_force(spark, least):
    """One block holds most texts, one word is in all of them, one in half; copies, nulls, empty and long texts."""
    rng = random.Random(int(least * 100))
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(150):
        base = ["road", *rng.choices(vocabulary, k=rng.randint(2, 9)), *(["Village"] if rng.random() < 0.5 else [])]
        for _ in range(rng.randint(1, 3)):
            rows.append((rng.choice("aaab"), " ".join(base)))
            base = [*base, rng.choice(vocabulary)] if rng.random() < 0.7 else base
    rows += [("a", None), ("a", ""), ("b", "?! ..."), (None, "road w1 w2"), ("a", "ROAD w1, w2"), ("a", "road-w1 w2"), ("a", "w3 " * 9000), ("b", "w3 " * 9000), ("a", "w3 " * 8999 + "w4")]
    got = text_similarity.similar_texts(spark.createDataFrame([(*r, "k", "w") for r in rows], SCHEMA), ["block"], "text", least)
    want = cosines(rows, least)
    assert len(want) >= 2 and {(r.text_a, r.text_b): r.similarity for r in got.collect()} == pytest.approx(want, abs=1.1e-4)
    assert text_similarity.similar_texts(spark.createDataFrame([], SCHEMA), ["block"], "text", least).count() == 0


def test_frequent_words_make_no_pairs(spark):
    """Two thousand texts of one block share four frequent words; each has three of its own: no word of a prefix is shared by many."""
    rows = [("a", f"work of the road x{k} y{k} z{k}") for k in range(2000)] + [("a", f"work of the road x{k} y{k} z{k} again") for k in range(5)]
    texts = spark.createDataFrame([(b, t, "k", "w") for b, t in rows], SCHEMA)
    weighed = text_similarity.weigh(texts.select("key", "text").withColumn("key", texts["text"]), "key", "text")
    prefix = weighed.where("tail >= 0.86")
    assert prefix.where("word in ('work', 'of', 'the', 'road')").count() == 0
    assert prefix.groupBy("word").count().agg({"count": "max"}).first()[0] <= 5
    assert text_similarity.similar_texts(texts, ["block"], "text", 0.8).count() == 5
