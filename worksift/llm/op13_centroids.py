"""Centroid clustering of integer vectors by equal-average equal-variance nearest-neighbour search.

Centroids are sorted by the sum of their components. A vector starts at its own sum and scans outward, the nearer side first.
With D = sqrt(n * sum of squares - sum^2) of n components, n * distance^2 >= (difference of sums)^2 + (difference of D)^2. The
first term alone ends a vector's scan once it exceeds the best distance, because it only grows outward; both together reject one
centroid. What neither rejects is decided by the exact integer distance, ties by the smaller number. The bounds are kept
in floating point with a margin for its rounding, so no centroid that could win or tie is rejected.

A round reads ``vec_id`` and ``embedding`` alone, each task adds its vectors up by cluster, and only clusters x components
numbers reach the driver. Sums are whole numbers of any size (two decimals each), so the result doesn't depend on the order of rows.

Defined results: vectors with another count of components, or with a null or non-finite one, are left out; an ``embedding`` that is
null too. A null vec_id is kept and starts a centroid only if other vectors don't suffice. Rows that share a vec_id are vectors
each, also if they are equal; where their hashes tie, the smaller vector starts first. With fewer vectors than centroids there are
as many centroids as vectors. Components beyond 2^24 are computed with Python's whole numbers: slower, still exact. A
distance or inertia that doesn't fit a long is null. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import stored

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components up to this size are computed with 64-bit numbers: their squares, summed and multiplied by 64, fit.
SMALL = 1 << 24
LONG = (1 << 63) - 1


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of whole numbers ``x`` the nearest centroid's number and squared distance; and the count of distances computed.

    Both arrays are int64 or both objects (Python's whole numbers).
    """
    k, n = centroids.shape
    sums = centroids.sum(axis=1)
    order = np.array(sorted(range(k), key=lambda i: (sums[i], i)))
    c, s = centroids[order], sums[order].astype(float)
    spread = np.sqrt((n * (c * c).sum(axis=1) - sums[order] ** 2).astype(float))
    own = x.sum(axis=1)
    own_spread = np.sqrt((n * (x * x).sum(axis=1) - own * own).astype(float))
    own = own.astype(float)
    right = np.searchsorted(s, own)
    left = right - 1
    best, number = np.zeros(len(x), dtype=x.dtype), np.full(len(x), k)
    bound = np.full(len(x), np.inf)  # n times the best distance
    active, computed = np.arange(len(x)), 0
    edge = np.append(s, np.inf)  # edge[k]: beyond the last one
    for _ in range(k):
        to_left = np.where(left[active] >= 0, own[active] - s[np.maximum(left[active], 0)], np.inf)
        to_right = edge[right[active]] - own[active]
        goes_left = to_left <= to_right
        gap = np.where(goes_left, to_left, to_right) ** 2
        going = gap * (1 - 1e-12) <= bound[active]
        active, goes_left, gap = active[going], goes_left[going], gap[going]
        if not len(active):
            break
        at = np.where(goes_left, left[active], right[active])
        left[active] -= goes_left
        right[active] += ~goes_left
        apart = np.abs(own_spread[active] - spread[at])
        low = gap + apart * apart
        near = low - 1e-12 * (low + apart * (own_spread[active] + spread[at])) - 1e-6 <= bound[active]
        rows, at = active[near], at[near]
        difference = x[rows] - c[at]
        distance = (difference * difference).sum(axis=1)
        computed += len(rows)
        names = order[at]
        wins = (number[rows] == k) | (distance < best[rows]) | ((distance == best[rows]) & (names < number[rows]))
        rows = rows[wins]
        best[rows], number[rows] = distance[wins], names[wins]
        bound[rows] = n * best[rows].astype(float)
    return number, best, computed


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x), as int64 if all fit ``SMALL``."""
    down = np.floor(SCALE * values)
    if not down.size or np.abs(down).max() <= SMALL:
        return down.astype(np.int64)
    return np.array([int(v) for v in down.ravel()], dtype=object).reshape(down.shape)


def _vectors(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _assigned(values: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, whole numbers, cluster, distance): the few vectors with large components apart from the others."""
    small_centroids = all(abs(v) <= SMALL for c in centroids for v in c)
    large = np.zeros(len(values), dtype=bool) if not len(values) else np.abs(np.floor(SCALE * values)).max(axis=1) > SMALL
    large |= not small_centroids
    for mask in (~large, large):
        rows = np.flatnonzero(mask)
        if len(rows):
            x = _whole(values[rows])
            x = x.astype(object) if mask is large else x
            number, best, _ = nearest(x, np.array(centroids, dtype=x.dtype))
            yield rows, x, number, best


def kept_vectors(vectors: DataFrame, n: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding): vectors of exactly ``n`` finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == n) & finite)


def starts(kept: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The whole numbers of the ``k`` vectors whose ids have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select("embedding", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "embedding").limit(k).collect()
    return [[int(v) for v in _whole(np.array(r["embedding"]))] for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each cluster's floor of the mean, by component; empty clusters stay."""
    n = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), n), dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, x, number, _ in _assigned(_vectors(batch, n), centroids):
                by = np.argsort(number, kind="stable")
                clusters, first = np.unique(number[by], return_index=True)
                sums[clusters] += np.add.reduceat(x[by], first, axis=0).astype(object)
                counts += np.bincount(number, minlength=len(centroids))
        cluster, component = (a.ravel() for a in np.indices(sums.shape))
        some = counts[cluster] > 0
        whole = [int(v) for v in sums.ravel()[some]]
        high, low = (pa.array([Decimal(v) for v in part], pa.decimal128(38, 0)) for part in ([v >> 64 for v in whole], [v & (1 << 64) - 1 for v in whole]))
        yield pa.RecordBatch.from_arrays([pa.array(cluster[some], pa.int32()), pa.array(component[some], pa.int32()), high, low, pa.array(counts[cluster[some]])], ["cluster", "component", "high", "low", "n"])

    parts = kept.select("embedding").mapInArrow(run, "cluster int, component int, high decimal(38,0), low decimal(38,0), n long")
    total = parts.groupBy("cluster", "component").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low", "n")))
    out = [list(c) for c in centroids]
    for r in total.collect():  # at most clusters x components rows
        out[r["cluster"]][r["component"]] = ((int(r["high"]) << 64) + int(r["low"])) // int(r["n"])
    return out


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) for (vec_id, embedding)."""
    n = len(centroids[0]) if centroids else COMPONENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=object)
            for rows, _, number, best in _assigned(_vectors(batch, n), centroids):
                cluster[rows], distance[rows] = number, best
            fits = pa.array([int(d) if d <= LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), fits], ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, n: int = COMPONENTS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector after ``rounds`` rounds, and the centroids."""
    kept = kept_vectors(vectors, n)
    centroids = starts(kept, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    return assign(kept, centroids), centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings``, with inertia and each centroid's digest."""
    assigned, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = stored(assigned)
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col(c).cast("decimal(38,0)")))  # noqa: E731  null if any distance is
    by = assigned.groupBy("cluster").agg(whole("distance").alias("inertia"))
    sums = {r["cluster"]: r["inertia"] for r in by.collect()}  # at most one row for each centroid
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda v: None if v is None or v > LONG else int(v)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, fits(v), fits(total), digest[c]) for c, v in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """One common table for the assignment and one for the centroids of each round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT row, cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c USING (i) GROUP BY row, cluster),
a{r} AS MATERIALIZED (
  SELECT row, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM v JOIN a{r} USING (row) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster AND m.i = c.i)""")
    return ",".join(steps)


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
v AS MATERIALIZED (
  SELECT row, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS x FROM kept, range(1, {COMPONENTS + 1}) t(i)),
first AS (
  SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS cluster FROM kept
  ORDER BY cluster LIMIT {CENTROIDS}),
c0 AS MATERIALIZED (SELECT cluster, i, x FROM first JOIN v USING (row)),{_rounds_sql()},
digest AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row) JOIN digest USING (cluster)
"""
