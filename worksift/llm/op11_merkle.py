"""Merkle manifest of a table with proofs made by octopus multiproofs.

Each row's digest is a leaf; leaves of a language, by doc_id, form one tree, and the trees' roots, by language, form the tree on
top. Trees are binary; the last node of a level that has no partner is hashed alone.

A tree is cut into leaf partitions of ``2 ** BITS`` consecutive leaves, so a language with all rows is many partitions. A
partition derives what lies above its leaves, hands its topmost node to the next pass, and lists the coordinates (tree, level,
place) of the nodes that its leaves' proofs need and that it can't derive: the octopus's minimal union, one node for
each level above the partition instead of one for each leaf and level. These are fetched by one join, once for each partition. A second
pass over the partition then derives the shared interiors again, reads each leaf's siblings off them and folds the leaf, or the
leaf as it was tampered with, up to the root. Higher levels are built likewise from the partitions' topmost nodes, in
as many passes as ``2 ** BITS`` goes into the largest tree.

Rows are hashed in the JVM; only digests are shuffled. The coordinates near the roots are needed by most partitions, so that join
deals hot keys to several tasks.

Defined results: null and empty fields have different digests; a null language is a tree of its own, the first one; an empty one
the second. A null doc_id comes before all others and is never tampered with. Rows that share a doc_id are leaves each, in the order
of their digests. A row with null n_chars that is to be tampered with stays as it is, so it is verified. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, running_sum, small, spread_join, stored

BITS = 10
#: Name of the tree over the trees' roots; languages' trees are called "" (null) or "=" and the language.
TOP = "*"
NODE = ["tree", "level", "place"]


def row_digest(*fields: Column) -> Column:
    """sha256 of the fields, each with its length in bytes before it, "-" if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (int(n) - 1).bit_length()


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of leaves at ``places``, of ``n``, need and that these leaves don't give."""
    out, here, width = [], np.unique(places), int(n)
    for level in range(height(n)):
        partner = here ^ 1
        needed = partner[(partner < width) & ~np.isin(partner, here, assume_unique=True)]
        out += [(level, int(p)) for p in needed]
        here, width = np.unique(here >> 1), (width + 1) // 2
    return out


def derive(nodes: dict[int, str], n: int, levels: int, fetched: dict[tuple[int, int], str] | None = None, level: int = 0) -> list[dict[int, str]]:
    """The nodes of each level, from those of ``level`` (of ``n``) up to ``levels`` above, with ``fetched`` ones put beside them."""
    out, width, own = [], int(n), set(nodes)
    for up in range(levels + 1):
        if fetched:
            nodes |= {p: h for (k, p), h in fetched.items() if k == level + up}
        out.append(nodes)
        above = {}
        for p in {p >> 1 for p in own} if up < levels else ():
            last = 2 * p + 1 >= width
            above[p] = joined(nodes[2 * p]) if last else joined(nodes[2 * p], nodes[2 * p + 1])
        nodes, own, width = above, set(above), (width + 1) // 2
    return out


def siblings(place: int, levels: list[dict[int, str]], n: int) -> list[str | None]:
    """The partners of the nodes on the way from ``place`` to the root; None where there is none."""
    out, width = [], int(n)
    for nodes in levels[: height(n)]:
        out.append(nodes[place ^ 1] if place ^ 1 < width else None)
        place, width = place >> 1, (width + 1) // 2
    return out


def fold(digest: str, place: int, partners: list[str | None]) -> str:
    """The root that a digest at ``place`` leads to."""
    for p in partners:
        digest = joined(digest) if p is None else joined(p, digest) if place & 1 else joined(digest, p)
        place >>= 1
    return digest


def _part() -> Column:
    return F.shiftright("place", BITS).alias("part")


def _climb(nodes: DataFrame) -> DataFrame:
    """(tree, level, place, digest, n, topmost): the nodes up to ``BITS`` levels above ``nodes``, of which each tree has ``n`` at their level."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree, level, n = rows["tree"].iloc[0], int(rows["level"].iloc[0]), int(rows["n"].iloc[0])
        up = min(BITS, height(n))
        made = derive(dict(zip(rows["place"], rows["digest"], strict=True)), n, up)
        out = [(tree, level + k, p, h, -(-n >> k), k == up) for k, found in enumerate(made) for p, h in found.items() if k]
        return pd.DataFrame(out, columns=[*NODE, "digest", "n", "topmost"])

    return nodes.groupBy("tree", _part()).applyInPandas(run, "tree string, level int, place long, digest string, n long, topmost boolean")


def _upper(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """All nodes from ``nodes`` up to the roots, and the roots (tree, digest). ``most``: nodes that the largest tree has at this level."""
    columns, found, roots = [*NODE, "digest"], nodes.select(*NODE, "digest"), nodes.where("n = 1").select("tree", "digest")
    while most > 1:
        made = cut(_climb(nodes.where("n > 1")))
        found = found.unionByName(made.select(*columns))
        nodes = made.where("topmost").drop("topmost")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most >> BITS)
    return found, roots


def numbered(rows: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered, place): the place of each leaf in its tree."""
    return stored(running_sum(rows, ["tree"], ["doc_id", "leaf"], F.lit(1).cast("long"), "place"))


def prove(leaves: DataFrame) -> DataFrame:
    """Proofs for (tree, doc_id, leaf, tampered): ``tree`` isn't null, ``tampered`` is the digest to be verified instead, or null.

    Adds subroot, root, proof (array of siblings' digests, from the leaf's to the root's level) and folded_root.
    """
    placed = numbered(leaves)
    sizes = cut(placed.groupBy("tree").agg(F.count("*").alias("n")))
    trees = cut(running_sum(sizes.withColumn("all", F.lit(TOP)), ["all"], ["tree"], F.lit(1).cast("long"), "top_place"))
    counted = trees.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    n_trees, most = counted["trees"], counted["most"] or 0

    def needs(rows: pd.DataFrame) -> pd.DataFrame:
        """What the partition hands on (with a digest) and the coordinates that it needs (without)."""
        tree, n, part = rows["tree"].iloc[0], int(rows["n"].iloc[0]), int(rows["place"].iloc[0]) >> BITS
        up = min(BITS, height(n))
        top = derive(dict(zip(rows["place"], rows["leaf"], strict=True)), n, up)[up][part]
        out = [(tree, part, tree, up, part, top, -(-n >> up))]
        out += [(tree, part, tree, k, p, None, 0) for k, p in missing(rows["place"].to_numpy(), n)]
        out += [(tree, part, TOP, k, p, None, 0) for k, p in missing(rows["top_place"].to_numpy()[:1], n_trees)]
        return pd.DataFrame(out, columns=["of_tree", "part", *NODE, "digest", "n"])

    leaf_rows = placed.join(small(trees.select("tree", "n", "top_place"), row_bytes=64), "tree")
    first = leaf_rows.select("tree", "place", "leaf", "n", "top_place").groupBy("tree", _part())
    first = cut(first.applyInPandas(needs, "of_tree string, part long, tree string, level int, place long, digest string, n long"))
    nodes, roots = _upper(first.where("digest is not null").select(*NODE, "digest", "n"), -(-most >> min(BITS, height(most))) if most else 0)
    tops = roots.join(trees.select("tree", "top_place"), "tree").select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("top_place").alias("place"), "digest", F.lit(n_trees).cast("long").alias("n"))
    top_nodes, _ = _upper(cut(tops), n_trees)
    fetched = spread_join(first.where("digest is null").drop("digest", "n"), nodes.unionByName(top_nodes), NODE)

    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        n, top_place = int(rows["n"].iloc[0]), int(rows["top_place"].iloc[0])
        upper = got["tree"] == TOP
        own, top = ({(int(k), int(p)): h for k, p, h in zip(x["level"], x["place"], x["digest"], strict=True)} for x in (got[~upper], got[upper]))
        levels = derive(dict(zip(rows["place"], rows["leaf"], strict=True)), n, height(n), own)
        subroot = levels[-1][0]
        over = derive({top_place: subroot}, n_trees, height(n_trees), top)
        root, beside = over[-1][0], siblings(top_place, over, n_trees)
        out = []
        for doc, place, leaf, tampered in zip(rows["doc_id"], rows["place"], rows["leaf"], rows["tampered"], strict=True):
            partners = siblings(place, levels, n)
            folded = fold(fold(tampered or leaf, place, partners), top_place, beside)
            out.append((doc, leaf, subroot, root, [p for p in partners + beside if p], folded))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof", "folded_root"])

    leaf_rows = leaf_rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids beside a null
    both = leaf_rows.groupBy("tree", _part()).cogroup(fetched.groupBy("of_tree", "part"))
    proved = both.applyInPandas(run, "doc_id string, leaf string, subroot string, root string, proof array<string>, folded_root string")
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): a seventh of the rows, by the checksum of their id, has n_chars changed."""
    doc, size = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    digest = lambda n: row_digest(doc, F.col("source"), F.col("lang"), n, F.col("text"))
    chosen = F.crc32(doc.cast("string")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree")
    return docs.select(tree, doc.alias("doc_id"), digest(size).alias("leaf"), F.when(chosen, digest(F.try_add(size, F.lit(1)))).alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and verified proofs of all ``documents``."""
    proved = prove(leaves_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


def _digest(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return f"sha256({' || '.join(map(_field, fields))})"


#: crc32 of the decimal doc_id, bit by bit: 3988292384 is the reversed polynomial.
CRC_SQL = """
xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ord(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)),
  4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, {_digest("n_chars")} AS leaf,
    CASE WHEN {CRC_SQL} % 7 = 0 THEN {_digest("n_chars + 1")} END AS tampered
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
kept AS MATERIALIZED (SELECT * FROM nodes),
roots AS MATERIALIZED (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM kept WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM roots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM top_nodes WHERE n > 1 GROUP BY level, place // 2, n),
top_kept AS MATERIALIZED (SELECT * FROM top_nodes),
heights AS (SELECT tree, max(level) AS height FROM kept GROUP BY tree),
steps AS MATERIALIZED (
  SELECT p.tree, p.place AS leaf_place, k.level AS step, (p.place >> k.level) & 1 AS is_right, s.digest AS sibling
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM kept WHERE n > 1) k USING (tree)
  LEFT JOIN kept s ON s.tree = p.tree AND s.level = k.level AND s.place = xor(p.place >> k.level, 1)
  UNION ALL
  SELECT p.tree, p.place, h.height + k.level, (r.place >> k.level) & 1, s.digest
  FROM placed p JOIN heights h USING (tree) JOIN roots r USING (tree) CROSS JOIN (SELECT DISTINCT level FROM top_kept WHERE n > 1) k
  LEFT JOIN top_kept s ON s.level = k.level AND s.place = xor(r.place >> k.level, 1)),
folded AS (
  SELECT tree, place AS leaf_place, 0 AS step, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.leaf_place, f.step + 1,
    sha256(CASE WHEN s.sibling IS NULL THEN f.digest WHEN s.is_right = 1 THEN s.sibling || f.digest ELSE f.digest || s.sibling END)
  FROM folded f JOIN steps s USING (tree, leaf_place, step)),
ends AS (SELECT tree, leaf_place, arg_max(digest, step) AS folded_root FROM folded GROUP BY tree, leaf_place),
proofs AS (
  SELECT tree, leaf_place, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY tree, leaf_place),
root AS (SELECT digest AS root FROM top_kept WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN roots USING (tree) CROSS JOIN root JOIN ends e ON e.tree = p.tree AND e.leaf_place = p.place
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_place = p.place
"""
