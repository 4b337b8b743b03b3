"""Exact nearest neighbours within blocks by pivots and the bisector bound.

Of unit vectors, a cosine of at least s is a distance of at most r = sqrt(2 - 2 s). Some vectors of a block, about six times the root
of its size, are its pivots: a third are drawn by hash, the others in two more draws, the farther a vector is from the pivots so far
the likelier, so that groups without a pivot get one. Each vector lives in the cell of its nearest pivot. If x lives with p and y with q, then the plane between p
and q lies between x and y, so d(x, y) >= (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)). A vector asks only the cells where that bound is at
most r, so no neighbour is missed. How many cells that are is up to the data: vectors that gather in groups ask few, evenly
spread ones of many dimensions ask all, as with any exact index.

Cells are kept on shelves of about ``SHELF`` vectors, those of near pivots together, and a vector goes once to each shelf that
has a cell for it. Large shelves are dealt to tasks by chunks of both sides, so that no task holds more than ``CHUNK`` vectors of
either. Equal vectors are compared as one; of their keys the first k + 1 can be anybody's nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worksift.plans.lineage import cut, small

SHELF, CHUNK = 2048, 4096
#: Added to bounds for the rounding of similarities to four places, and of floating point.
MARGIN = 1e-4


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances, as zero vectors have them too."""
    return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0.0)


def _pivots_of(dealt: DataFrame, chosen) -> DataFrame:
    """The chosen rows of ``dealt`` as pivots, for each chunk of their block; columns have names of their own, as both sides come from one table."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return dealt.where(chosen).select("block", "shelves", "vid", "vector", every.alias("at")).toDF("p_block", "p_shelves", "pid", "p_vector", "p_chunk")


def _batches(x: np.ndarray, p: np.ndarray):
    """(rows, squared distances to the pivots, nearest pivot) in batches of bounded size."""
    size = max(1, (1 << 22) // max(len(p), 1))
    for at in range(0, len(x), size):
        d = _distances(x[at : at + size], p)
        yield np.arange(at, min(at + size, len(x))), d, d.argmin(axis=1)


def _deal(values: DataFrame, draws: int = 2) -> DataFrame:
    """(block, vid, vector, chunk, chunks, shelves, pivot): blocks in chunks, and which of their vectors are pivots."""
    sizes = small(cut(values.groupBy("block").agg(F.count("*").alias("n"), F.min("vid").alias("first"))), 64)
    dealt = values.join(sizes, "block").withColumns({"shelves": F.ceil(F.col("n") / SHELF), "chunks": F.ceil(F.col("n") / CHUNK)})
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")))
    uniform = lambda seed: F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    dealt = cut(dealt.withColumn("pivot", (uniform(5) * F.sqrt("n") < 2.0) | (F.col("vid") == F.col("first"))))
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}

    def far(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        x, p = _matrix(rows["vector"]), _matrix(at["p_vector"])
        d = np.concatenate([d.min(axis=1) for _, d, _ in _batches(x, p)])
        return pd.DataFrame({"block": rows["block"], "vid": rows["vid"], "d": d})

    for draw in range(draws):
        both = dealt.select("block", "chunk", "vid", "vector").groupBy("block", "chunk").cogroup(_pivots_of(dealt, "pivot").groupBy("p_block", "p_chunk"))
        away = cut(both.applyInPandas(far, f"block {kinds['block']}, vid {kinds['vid']}, d double"))
        sums = small(cut(away.groupBy("block").agg(F.sum("d").alias("all"))), 64)
        likely = away.join(sums, "block").where("all > 0").select("block", "vid", (F.col("d") / F.col("all")).alias("share"))
        drawn = dealt.join(likely, ["block", "vid"], "left").withColumn("pivot", F.col("pivot") | (uniform(6 + draw) < 2.0 * F.sqrt("n") * F.coalesce("share", F.lit(0.0))))
        dealt = cut(drawn.drop("share"))
    return dealt


def placed(values: DataFrame, least: float) -> DataFrame:
    """(block, vid, vector, shelf, cell, asks): where each of (block, vid, vector) lives, and the (shelf, cells) that it asks; no cells: all."""
    dealt = _deal(values)
    reach = float(np.sqrt(max(2 - 2 * (least - MARGIN), 0.0))) + 1e-9

    def run(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        at = at.sort_values("pid")
        p, x = _matrix(at["p_vector"]), _matrix(rows["vector"])
        shelf = _distances(p, p[: int(at["p_shelves"].iloc[0])]).argmin(axis=1)
        members = np.bincount(shelf)
        home, asks = np.zeros(len(x), dtype=int), []
        for some, d, cell in _batches(x, p):
            home[some] = cell
            apart = np.sqrt(_distances(p[cell], p))
            own = d[np.arange(len(some)), cell]
            bound = np.where(apart > 1e-9, (d - own[:, None]) / (2 * np.maximum(apart, 1e-9)), 0.0)
            for row in bound <= reach:
                cells = np.flatnonzero(row)
                on = shelf[cells]
                lists = [(s, cells[on == s]) for s in np.unique(on)]
                asks.append([{"shelf": int(s), "cells": [] if len(c) == members[s] else c.tolist()} for s, c in lists])
        return pd.DataFrame({"block": rows["block"], "vid": rows["vid"], "vector": rows["vector"], "shelf": shelf[home], "cell": home, "asks": asks})

    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    schema = f"block {kinds['block']}, vid {kinds['vid']}, vector array<double>, shelf int, cell int, asks array<struct<shelf: int, cells: array<int>>>"
    both = dealt.select("block", "chunk", "vid", "vector").groupBy("block", "chunk").cogroup(_pivots_of(dealt, "pivot").groupBy("p_block", "p_chunk"))
    return both.applyInPandas(run, schema)


def compared(at: DataFrame) -> DataFrame:
    """(block, comparisons): pairs of vectors that ``near`` compares, by the cells that were asked."""
    cells = at.groupBy("block", "shelf", "cell").agg(F.count("*").alias("members"))
    shelves = cells.groupBy("block", "shelf").agg(F.sum("members").alias("members"))
    asked = at.select("block", F.explode("asks").alias("a")).select("block", "a.shelf", "a.cells")
    some = asked.select("block", "shelf", F.explode("cells").alias("cell")).join(cells, ["block", "shelf", "cell"])
    whole = asked.where("size(cells) = 0").join(shelves, ["block", "shelf"])
    return some.select("block", "members").unionByName(whole.select("block", "members")).groupBy("block").agg(F.sum("members").alias("comparisons"))


def near(at: DataFrame, least: float, k: int) -> DataFrame:
    """(block, x, y, similarity) of vectors of a block with a cosine of at least ``least``: every y that can be among x's ``k`` nearest, x itself too."""
    members = at.select("block", "shelf", "vid", "vector", "cell")
    visitors = at.select("block", "vid", "vector", F.explode("asks").alias("a")).select("block", F.col("a.shelf").alias("shelf"), "vid", "vector", F.col("a.cells").alias("cells"))
    sizes = members.groupBy("block", "shelf").agg(F.count("*").alias("m")).join(visitors.groupBy("block", "shelf").agg(F.count("*").alias("v")), ["block", "shelf"])
    sizes = small(cut(sizes.select("block", "shelf", F.ceil(F.col("m") / CHUNK).alias("rows_"), F.ceil(F.col("v") / CHUNK).alias("columns_"))), 64)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vid", F.lit(3)), F.col(n))
    members = members.join(sizes, ["block", "shelf"]).select("block", "shelf", own("rows_").alias("i"), every("columns_").alias("j"), "vid", "vector", "cell")
    visitors = visitors.join(sizes, ["block", "shelf"]).select("block", "shelf", every("rows_").alias("i"), own("columns_").alias("j"), "vid", "vector", "cells")
    visitors = visitors.toDF("v_block", "v_shelf", "v_i", "v_j", "v_vid", "v_vector", "cells")

    def run(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(m) and len(v):
            lists = v["cells"].to_numpy()
            asker, asked = np.repeat(np.arange(len(v)), [len(c) for c in lists]), np.concatenate(lists)
            all_ = np.flatnonzero([not len(c) for c in lists])
            x, y, names = _matrix(v["v_vector"]), _matrix(m["vector"]), m["vid"].to_numpy()
            homes = m["cell"].to_numpy()
            for cell in np.unique(homes):
                there, here = np.flatnonzero(homes == cell), np.concatenate([asker[asked == cell], all_])
                s = x[here] @ y[there].T
                a, b = np.nonzero(s >= least - MARGIN)
                found.append(pd.DataFrame({"block": m["block"].iloc[0], "x": v["v_vid"].to_numpy()[here[a]], "y": names[there[b]], "similarity": s[a, b]}))
        if not found:
            return pd.DataFrame({"block": [], "x": [], "y": [], "similarity": []})
        rows = pd.concat(found)
        # the k nearest others and x itself; rounded as they are ranked later
        rows = rows.assign(r=-np.floor(rows["similarity"] * 1e4 + 0.5)).sort_values(["x", "r", "y"])
        return rows[rows.groupby("x").cumcount() <= k].drop(columns="r")

    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    group = ["block", "shelf", "i", "j"]
    out = members.groupBy(*group).cogroup(visitors.groupBy("v_block", "v_shelf", "v_i", "v_j")).applyInPandas(run, f"block {kinds['block']}, x {kinds['vid']}, y {kinds['vid']}, similarity double")
    return out.withColumn("similarity", F.round("similarity", 4)).where(F.col("similarity") >= least)


def nearest(unit: DataFrame, block: list[str], key: str, vector: str, k: int, least: float) -> DataFrame:
    """(block..., a, b, similarity), a < b, of unit vectors: pairs within a block where the smaller key lists the larger among its ``k`` nearest.

    Nearest is the most similar, rounded to four places, then the smaller key. Rows with a null in the block or vector meet nothing.
    """
    whole = F.to_json(F.struct(*block))
    names = [f"of_{n}" for n in range(len(block))]  # the caller's columns may be called like ours
    rows = cut(unit.dropna(subset=[*block, key, vector]).select(*(F.col(c).alias(n) for c, n in zip(block, names, strict=True)), whole.alias("block"), F.col(key).alias("key"), F.md5(F.col(vector).cast("string")).alias("same"), F.col(vector).cast("array<double>").alias("vector")))
    values = cut(rows.groupBy("block", "same").agg(F.min("key").alias("vid"), F.any_value("vector").alias("vector"), F.count("*").alias("copies")))
    at = cut(placed(values.select("block", "vid", "vector"), least))
    pairs = near(at, least, k)
    first = F.row_number().over(Window.partitionBy("block", "same").orderBy("key"))
    keys = rows.select("block", "same", "key").withColumn("_r", first).where(F.col("_r") <= k + 1).join(values.select("block", "same", "vid"), ["block", "same"])
    met = pairs.join(keys.select("block", F.col("vid").alias("y"), "key"), ["block", "y"])
    ranked = met.withColumn("_r", F.row_number().over(Window.partitionBy("block", "x").orderBy(F.desc("similarity"), "key"))).where(F.col("_r") <= k + 1)
    lists = ranked.groupBy("block", F.col("x").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("_r", "key", "similarity"))).alias("near"))
    named = rows.select(*names, "block", "same", "key").join(values.select("block", "same", "vid"), ["block", "same"]).join(lists, ["block", "vid"])
    own = named.select(*names, F.col("key").alias("a"), F.explode(F.slice(F.filter("near", lambda n: n["key"] != F.col("key")), 1, k)).alias("n"))
    return own.select(*(F.col(n).alias(c) for c, n in zip(block, names, strict=True)), "a", F.col("n.key").alias("b"), F.col("n.similarity").alias("similarity")).where("a < b")
