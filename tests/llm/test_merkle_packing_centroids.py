"""Brute force, round trips and odd rows for the manifest (11), retrieval packing (12) and centroid clustering (13)."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksift.llm import op11_merkle as merkle
from worksift.llm import op12_retrieval_packing as packing
from worksift.llm import op13_centroids as centroids

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place string, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    """All levels of a tree, by the definition."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def manifest(rows):
    """What the query returns, recomputed with every proof walked alone."""

    def digest(row, more=0):
        doc, source, lang, n, text = row
        values = [doc, source, lang, None if n is None else n + more, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    built = [levels([digest(r) for r in trees[name]]) for name in names]
    over = levels([b[-1][0] for b in built])
    out = []
    for at, name in enumerate(names):
        for place, row in enumerate(trees[name]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            folded, proof = digest(row, int(tampered)), []
            for made, p in ((built[at], place), (over, at)):
                for level in made[:-1]:
                    run = level[p - p % 2 : p - p % 2 + 2]
                    others = [x for k, x in enumerate(run) if k != p % 2]
                    proof += others
                    run[p % 2] = folded
                    folded, p = sha("".join(run)), p // 2
            out.append((row[0], digest(row), built[at][-1][0], over[-1][0], sha("".join(proof)), folded, folded == over[-1][0]))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def query(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], DOCS)
    proved = merkle.prove(merkle.leaves_of(docs))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", F.col("folded_root") == F.col("root")).collect()


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_brute_force(spark, monkeypatch, bits):
    """Trees of 1 to 45 leaves, in partitions of 2, 4 or more leaves; a null and an empty language, ties, repeated rows, null ids."""
    monkeypatch.setattr(merkle, "BITS", bits)
    rng = random.Random(bits)
    rows = [(k, rng.choice("ab"), lang, rng.choice([None, 3, 2**40]), f"t{k}é") for k, lang in enumerate([None] * 7 + [""] * 2 + ["en"] * 45 + ["fr"] * 16 + ["é"])]
    rows += [(None, None, "en", None, None), (None, "s", "en", 4, ""), (3, "a", "fr", 1, "t"), (3, "a", "fr", 1, "t"), (2**60, "a", "fr", 1, "x " * 60_000), (1 << 53, "b", "fr", 2, "u"), ((1 << 53) + 1, "b", "fr", 2, "u")]
    want = manifest(rows)
    assert {r[-1] for r in want} == {True, False}
    same(query(spark, rows), want)


def test_manifest_of_one_tree_one_leaf_and_nothing(spark):
    for rows in ([(7, "s", None, 1, "a")], [(k, "s", "en", k, "a") for k in range(9)], [(1, "s", "a", 1, "x"), (2, "s", "b", 1, "x")]):
        same(query(spark, rows), manifest(rows))
    assert query(spark, []) == []


@pytest.mark.parametrize("seed", range(5))
def test_octopus_fetches_the_least(seed):
    """For any set of leaves: together with these the fetched nodes give every proof, and without any one of them they don't."""
    rng = random.Random(seed)
    n = rng.randint(1, 70)
    tree = levels([sha(str(k)) for k in range(n)])
    places = sorted(rng.sample(range(n), rng.randint(1, n)))
    coordinates = merkle.missing(np.array(places), n)
    got = {(k, p): tree[k][p] for k, p in coordinates}
    derived = merkle.derive({p: tree[0][p] for p in places}, n, merkle.height(n), got)
    assert derived[-1] == {0: tree[-1][0]}
    for p in places:
        partners = merkle.siblings(p, derived, n)
        assert merkle.fold(tree[0][p], p, partners) == tree[-1][0]
        if n > 1:
            assert merkle.fold(sha("other"), p, partners) != tree[-1][0]
    for c in coordinates:
        with pytest.raises(KeyError):
            merkle.derive({p: tree[0][p] for p in places}, n, merkle.height(n), {k: v for k, v in got.items() if k != c})


# ---------------------------------------------------------------- retrieval packing


def check_pieces(rows, texts, capacity=packing.CAPACITY):
    """Every id is in exactly one piece, sequences have no gap, and none is padded."""
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc, text in texts:
        want[doc, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    copies = collections.Counter(doc for doc, _ in texts)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for doc, parts in by_doc.items():
        if copies[doc] == 1:
            ids = []
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == len(ids)
                ids += r.ids
            assert want[doc, tuple(ids)] == 1 and {r.doc_tokens for r in parts} == {len(ids)}
        else:
            assert sum(r.length for r in parts) == sum(len(ids) * n for (d, ids), n in want.items() if d == doc)
    assert set(by_doc) == set(copies)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    return by_sequence


@pytest.mark.parametrize("shard", [3000, packing.SHARD_IDS])
def test_retrieval_packing(spark, monkeypatch, shard):
    """Odd rows, long documents, copies and clashing names, in one shard and in many."""
    monkeypatch.setattr(packing, "SHARD_IDS", shard)
    rng = random.Random(4)
    texts = [(k, " ".join(f"{rng.choice(['house', 'river', 'stone'])}{rng.randrange(50)}" for _ in range(rng.randint(1, 500)))) for k in range(60)]
    texts += [(100 + k, texts[0][1]) for k in range(40)] + [(200, None), (201, ""), (None, "a b"), (202, "x " * 9000), (203, "same"), (203, "same"), (204, "<|endoftext|> é 漢字 \x00"), (205, " " * 5000)]
    docs = spark.createDataFrame([(d, t, 1, 2, "n") for d, t in texts], "doc_id long, text string, `row` long, start long, near string").repartition(3)
    check_pieces(packing.pack_by_retrieval(docs, with_ids=True).collect(), texts)
    plain = packing.pack_by_retrieval(docs)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and packing.pack_by_retrieval(docs.limit(0)).count() == 0


def test_windows_hold_documents_about_one_thing(spark):
    """Twelve subjects with words of their own: neighbours in a window share the subject, unless it is used up."""
    rng = random.Random(9)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    subjects = [["".join(rng.sample(syllables[5 * n : 5 * n + 8], 3)) for _ in range(60)] for n in range(12)]
    texts = [(k, " ".join(rng.choice([rng.choice(subjects[k % 12]), "the", "of", "and"]) for _ in range(150))) for k in range(480)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    sequences = check_pieces(packing.pack_by_retrieval(docs, with_ids=True).collect(), texts)
    pairs = [(a.doc_id % 12, b.doc_id % 12) for parts in sequences.values() for a, b in zip(parts, parts[1:], strict=False)]
    assert sum(a == b for a, b in pairs) > 0.75 * len(pairs) > 100


def test_index_equals_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, rng.integers(1, 80)).astype(np.int32) for _ in range(50)]
    held = collections.Counter(t for d in docs for t in set(d.tolist()))
    weights = np.log1p([(50 - held[t] + 0.5) / (held[t] + 0.5) for t in range(packing.VOCABULARY)])
    mean = sum(map(len, docs)) / 50
    index = packing.Index.of(docs, weights, mean)
    for q in docs[:10]:
        want = []
        for d in docs:
            tf = collections.Counter(d.tolist())
            want.append(sum(weights[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist())))
        scores = index.scores(np.unique(q))
        assert np.allclose(scores, want)
        used = rng.random(50) < 0.3
        ranked = sorted((i for i in range(50) if not used[i]), key=lambda i: (-scores[i], i))
        assert list(packing.best_unused(scores, used)) == ranked
        assert np.allclose(index.only(~used).scores(np.unique(q)), scores[~used])
    many = np.repeat([1.0, 2.0], 400)
    assert list(packing.best_unused(many, np.zeros(800, dtype=bool))) == [*range(400, 800), *range(400)]


# ---------------------------------------------------------------- centroids


def cluster(rows, k, rounds):
    """Lloyd's rounds by brute force in whole numbers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))
    c = [list(v) for _, v in start[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        for n, vectors in groups.items():
            c[n] = [sum(x) // len(vectors) for x in zip(*vectors, strict=True)]
    return [(i, place(v)[1], place(v)[0]) for i, v in kept], c


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string"


@pytest.mark.parametrize("rows", [300, 25])
def test_clusters_equal_brute_force(spark, rows):
    """Ties, copies, one very common vector, repeated ids, odd vectors; more and fewer vectors than centroids."""
    rng = random.Random(rows)
    made = [(k, [rng.choice([-1.0, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(64)]) for k in range(rows)]
    made += [(1000 + k, made[0][1]) for k in range(rows // 2)] + [(5, made[7][1]), (5, made[8][1]), (None, made[9][1])]
    made += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [None, *[1.0] * 63]), (2004, [float("nan"), *[1.0] * 63]), (2005, [float("-inf"), *[1.0] * 63]), (2006, [])]
    made = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in made]
    got, c = centroids.cluster_vectors(spark.createDataFrame([(*r, 1, "c", "d") for r in made], VECTORS).repartition(3), 40, 5)
    want, final = cluster(made, 40, 5)
    same(got.select("vec_id", "cluster", "distance").collect(), want)
    assert c == final


def test_large_components(spark):
    rng = random.Random(2)
    made = [(k, [float(np.float32(rng.gauss(0, 1) * 10 ** (k % 3 * 4))) for _ in range(64)]) for k in range(60)]
    want, final = cluster(made, 40, 5)
    got, c = centroids.cluster_vectors(spark.createDataFrame([(*r, 1, "c", "d") for r in made], VECTORS))
    same(got.collect(), want)
    huge = [*made, (100, [float(np.float32(3e38))] * 64)]
    got, c = centroids.cluster_vectors(spark.createDataFrame([(*r, 1, "c", "d") for r in huge], VECTORS))
    want, final = cluster(huge, 40, 5)
    same(got.collect(), [(i, n, d if d < 2**63 else None) for i, n, d in want])
    assert c == final and centroids.cluster_vectors(spark.createDataFrame([], VECTORS))[0].count() == 0


def test_search_rejects_and_stays_exact():
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (40, 64)) + 200 * rng.integers(-5, 6, (40, 1))
    x = np.concatenate([c[rng.integers(0, 40, 500)] + rng.integers(-60, 60, (500, 64)), c, np.repeat(c[:3], 4, axis=0)])
    c[9] = c[4]  # a tie goes to the smaller number
    number, best, computed = centroids.nearest(x, c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and computed < 0.4 * every.size
    as_objects = centroids.nearest(x.astype(object), c.astype(object))
    assert (as_objects[0] == number).all() and (as_objects[1] == best).all()
