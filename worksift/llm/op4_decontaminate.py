"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows: ten consecutive words of an item, or a shorter item as a whole. For each
pattern length one searcher holds a shift table from blocks of two words to the distance that the search may skip, and
buckets of test patterns under their last block, split by their first one; a direct comparison confirms an occurrence.

The benchmark is a stated query set. It is measured first and cut into blocks of ``BLOCK_BYTES`` of text, so what is
broadcast at once is bounded however large it grows; every block searches all documents, one block after the other.

Defined results: null, empty or wordless texts have no words and no hits; items without an id, a text or words make no
window; repeated items count once by id; repeated documents give a row each; extra columns are carried along, but for
``n_words``, ``spans`` and ``items``, which are replaced; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, fresh, stored

WINDOW = 10
#: Bytes of benchmark text whose patterns are broadcast and searched at once.
BLOCK_BYTES = 2 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RESULT = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words_of_bytes(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, ASCII letters and all non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Searcher:
    """Wu-Manber over word sequences that are all ``length`` words long."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                part = words[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.skip), length - end)
            under = self.buckets.setdefault(words[length - self.block :], {})
            under.setdefault(words[: self.block], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence, by place."""
        length, block, shift, skip, buckets = self.length, self.block, self.shift, self.skip, self.buckets
        end, n = length, len(words)
        while end <= n:
            part = tuple(words[end - block : end])
            step = shift.get(part, skip)
            if step:
                end += step
                continue
            start = end - length
            for tested, items in buckets[part].get(tuple(words[start : start + block]), ()):
                if tested == tuple(words[start:end]):
                    yield start, end, items
            end += 1


def searchers(items: list[tuple[str, str]], window: int) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = words_of_bytes(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            ids = by_length.setdefault(size, {}).setdefault(tuple(words[start : start + size]), [])
            if item not in ids:
                ids.append(item)
    return [Searcher(size, found) for size, found in sorted(by_length.items())]


def find(words: list[bytes], using: list[Searcher]) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged word spans that occurrences cover, and the items they belong to."""
    hits = [x for s in using for x in s.search(words)]
    return _joined([x[:2] for x in hits]), sorted({item for x in hits for item in x[2]})


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of the words that ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its text, with n_words, spans and items: merged hit spans in words, and ids of items that occur.

    With several blocks, every block but the first keeps the rows with hits only, so documents are written once, and what
    the blocks found for a row is merged in one pass.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "items").withColumn("text", F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).dropna()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1

    def searched(rows: DataFrame, k: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        sent = spark.sparkContext.broadcast({"items": [(r.item, r.text) for r in part]})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = sent.value  # the worker's copy, which outlives this task: its searchers are built once a worker
            if "searchers" not in own:
                own["searchers"] = searchers(own["items"], window)
            for batch in batches:
                out = []
                for text in batch["text"]:
                    words = words_of_bytes(text)
                    spans, found = find(words, own["searchers"])
                    out.append((len(words), [{"start": a, "end": b} for a, b in spans], found))
                yield pd.concat([batch.drop(columns="text"), pd.DataFrame(out, columns=["n_words", "spans", "items"], index=batch.index)], axis=1)

        return rows.mapInPandas(run, _schema(rows, "text", _RESULT))

    if blocks == 1:
        return searched(docs, 0)
    row = fresh(docs, "row")[0]
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))  # ids must not change from block to block
    first = stored(searched(docs, 0))
    hits = [searched(docs.select(row, "text"), k).where(F.size("spans") > 0).select(row, "spans", "items") for k in range(1, blocks)]
    more = reduce(DataFrame.unionByName, map(cut, hits)).groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    both = first.join(more, row, "left").drop(row)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, (spans, names, further, others) in enumerate(zip(batch["spans"], batch["items"], batch["more_spans"], batch["more_items"], strict=True)):
                if further is not None:
                    found = _joined([(x["start"], x["end"]) for x in (*spans, *further)])
                    batch.iat[k, batch.columns.get_loc("spans")] = [{"start": a, "end": b} for a, b in found]
                    batch.iat[k, batch.columns.get_loc("items")] = sorted({*names, *others})
            yield batch.drop(columns=["more_spans", "more_items"])

    return both.mapInPandas(merge, _schema(docs, (row, "text"), _RESULT))


def _schema(rows: DataFrame, without: str | tuple[str, ...], more: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name not in ((without,) if isinstance(without, str) else without)) + more


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all ``benchmark`` windows in all ``documents``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH iw AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS w FROM iw WHERE len(ws) > 0),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
ms AS (SELECT DISTINCT m FROM p),
e AS (SELECT doc_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: struct_pack(i := i, w := array_to_string(ws[i:i + m - 1], ' ')))) AS x FROM d, ms WHERE len(ws) >= m),
o AS (SELECT e.doc_id, e.m, e.x.i AS i, p.item_id FROM e JOIN p ON p.m = e.m AND p.w = e.x.w),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM o GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, coalesce(t.s, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
