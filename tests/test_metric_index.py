"""Exact neighbours by pivots: brute force, copies, odd rows, and how much is compared."""

import numpy as np
import pandas as pd
import pytest

from worksift.operators import metric_index, similarity

SCHEMA = "block string, place int, k long, vector array<float>, cell int, vid long"


def frame(spark, blocks, vectors):
    rows = [(b, 1, i, None if v is None else [float(x) for x in v], 0, 0) for i, (b, v) in enumerate(zip(blocks, vectors, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def neighbours(blocks, vectors, k, least):
    """Every vector against all others of its block, by the definition."""
    out = {}
    unit = [np.array(v, float) / max(np.linalg.norm(v), 1e-9) for v in vectors]
    for i in range(len(unit)):
        if blocks[i] is None:
            continue
        near = [(-round(float(unit[i] @ unit[j]), 4), j) for j in range(len(unit)) if j != i and blocks[j] == blocks[i]]
        near = sorted(x for x in near if -x[0] >= least)[:k]
        out |= {(i, j): -s for s, j in near if i < j}
    return out


@pytest.mark.parametrize("least,k", [(0.86, 5), (0.5, 2), (-1.0, 3), (0.97, 1)])
def test_neighbours_equal_brute_force(spark, monkeypatch, least, k):
    """Groups, spread vectors, a hot copy, zero vectors, one block with most rows, small shelves and chunks."""
    monkeypatch.setattr(metric_index, "SHELF", 30)
    monkeypatch.setattr(metric_index, "CHUNK", 25)
    rng = np.random.default_rng(int(100 * abs(least)))
    centres = rng.normal(size=(9, 6))
    vectors = [*(centres[rng.integers(9, size=120)] + 0.25 * rng.normal(size=(120, 6))), *rng.normal(size=(40, 6)), *[centres[0]] * 70, *[np.zeros(6)] * 3]
    vectors = [v.astype(np.float32) for v in vectors]
    blocks = list(rng.choice(["a", "a", "a", "b", None], size=len(vectors)))
    got = similarity.neighbours(frame(spark, blocks, vectors), ["block", "place"], "k", k, least)
    want = neighbours(blocks, vectors, k, least)
    found = {(r.a, r.b): r.similarity for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1.5e-4 for p in want) and got.columns == ["block", "place", "a", "b", "similarity"]


def test_odd_vectors(spark):
    assert similarity.neighbours(frame(spark, [], []), ["block"], "k").count() == 0
    got = similarity.neighbours(frame(spark, ["a", "a", "a", None], [[1, 0], None, [1, 0.1], [1, 0]]), ["block"], "k").collect()
    assert [(r.a, r.b) for r in got] == [(0, 2)]


def test_a_large_block_is_compared_in_part(spark):
    """One block of 20,000 vectors in 64 dimensions, 150 groups: at most a tenth of all comparisons, none missed for a sample."""
    rng = np.random.default_rng(2)
    n, groups = 20_000, 150
    centres = rng.normal(size=(groups, 64))
    x = (centres[rng.integers(groups, size=n)] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"block": "a", "vid": np.arange(n), "vector": [v.tolist() for v in x]}), "block string, vid long, vector array<double>")
    unit = similarity.normalise(rows).repartition(8)
    at = metric_index.placed(unit.select("block", "vid", "vector"), 0.86).cache()
    compared = metric_index.compared(at).first()["comparisons"]
    assert compared < n * n / 10
    got = {(r.x, r.y) for r in metric_index.near(at, 0.86, 5).where("x < 100").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(100):
        s = np.round((u[i] @ u.T).astype(float), 4)
        best = sorted((-s[j], j) for j in np.flatnonzero(s >= 0.8605))[:6]
        assert all((i, j) in got for v, j in best if -v > -best[-1][0] + 1e-3 or len(best) < 6)
