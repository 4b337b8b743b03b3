"""Lexical retrieval packing: documents that share rare words are put into one window.

Texts become token ids plus an end id. A longer document's leading windows of ``CAPACITY`` ids are sequences of their own; the rest of
each document, less than a window, is packed beside its neighbours. Terms are token ids, so the count of documents that hold
each is a table of bounded size (the vocabulary), and it counts all documents.

The BM25 index is sharded. Documents are sorted by three weighted min-hashes of their terms, where a rare term is the more
likely minimum, so that documents with the same rare terms stand together; each run of at most ``SHARD_IDS`` ids and
``SHARD_DOCS`` documents is a shard with an inverted index of its own. A seed document asks the shard's index for its best
unused neighbours, exactly, and these fill its window from the best one down. The one that no longer fits is cut, and its
rest is the next seed; else the next unused document is. So every window is full but the last one of each task, whose ids are
dealt to sequences of powers of two: nothing is padded.

Ids cross the network once, in the sort; a task holds one shard at a time. The sort's last key numbers the rows, so that
copies, however many, are split over tasks.

Ids are computed by tiktoken from the vocabulary's ranks; the tests compare them with those of the unmodified tokenizer.

Defined results: a null text is empty and is the end id alone; repeated rows are packed each; a null doc_id is carried
along; extra columns are ignored; an empty table gives no rows. Documents without a common term fill windows in the sort's order.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import stored
from worksift.llm.op9_packing import RANKS_FILE, SPECIAL

CAPACITY, END_ID, VOCABULARY = 2048, 1, 50_257
#: Bounds of a shard; both keep a task's memory and the time of a query bounded.
SHARD_IDS, SHARD_DOCS = 1 << 20, 4096
#: Fixed values of BM25: saturation of a term's count, and weight of the length.
K1, B = 1.2, 0.75
#: Documents tokenised into one batch.
BATCH = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, ranks_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, windows, leading, rest, terms): a row for each document.

    ``windows`` are the checksums of its leading full windows, ``leading`` the ids of these if wanted, ``rest`` the ids after them,
    ``terms`` its different ids.
    """
    import public_tokenizers

    path, pattern = ranks_file or public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN

    def lists(arrays: list, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows = [np.append(encoding.encode_to_numpy(t.as_py() or "", allowed_special="all"), END_ID).astype(np.int32) for t in batch.column("text")]
                cuts = [len(r) - len(r) % CAPACITY for r in rows]
                sums = [np.array([_checksum(r[k : k + CAPACITY]) for k in range(0, c, CAPACITY)], np.int64) for r, c in zip(rows, cuts, strict=True)]
                leading = [r[:c] if with_ids else r[:0] for r, c in zip(rows, cuts, strict=True)]
                rest, terms = [r[c:] for r, c in zip(rows, cuts, strict=True)], [np.unique(r) for r in rows]
                columns = [pa.array([len(r) for r in rows], pa.int64()), lists(sums, pa.int64()), *(lists(x, pa.int32()) for x in (leading, rest, terms))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "doc_tokens", "windows", "leading", "rest", "terms"])

    schema = "doc_id long, doc_tokens long, windows array<long>, leading array<int>, rest array<int>, terms array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def rarity(made: DataFrame) -> tuple[np.ndarray, float]:
    """BM25's weight of each term, over all documents, and the mean count of ids; at most ``VOCABULARY`` rows reach the driver."""
    total = made.agg(F.count("*").alias("n"), F.avg("doc_tokens").alias("mean")).first()
    held = np.zeros(VOCABULARY)
    for r in made.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r["term"]] = r["count"]
    return np.log1p((total["n"] - held + 0.5) / (held + 0.5)), total["mean"] or 1.0


def near_keys(made: DataFrame, weights: np.ndarray) -> list:
    """Three columns by which documents with common rare terms sort together: for each, the term with the smallest random number.

    The numbers are exponential with the term's weight as rate: two documents agree in one with the weighted share of their common terms.
    """
    rng = np.random.default_rng(12)
    draws = [rng.exponential(size=VOCABULARY) / np.maximum(weights, 1e-9) for _ in range(3)]
    ranks = [np.argsort(np.argsort(d)).astype(np.int32) for d in draws]

    @F.arrow_udf("array<int>")
    def key(terms: pa.Array) -> pa.Array:
        at = terms.offsets.to_numpy()
        flat = terms.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]  # each document has its end id, so no list is empty
        found = np.stack([np.minimum.reduceat(r[flat], at[:-1] - at[0]) for r in ranks], axis=1) if len(terms) else np.zeros((0, 3), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(terms) + 1, 3), pa.int32()), pa.array(found.ravel()))

    return key("terms")


class Index:
    """Inverted BM25 index: the impact of each (term, document), sorted by term. Terms that many documents hold are rows of a matrix."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n: int) -> None:
        self.term, self.doc, self.impact, self.n = term, doc, impact, n
        self.begin = np.searchsorted(term, np.arange(VOCABULARY + 1))
        self.common = np.flatnonzero(np.diff(self.begin) * 8 > n)
        self.row = np.full(VOCABULARY, -1)
        self.row[self.common] = np.arange(len(self.common))
        self.matrix = np.zeros((len(self.common), n))
        rows = self.row[term]
        self.matrix[rows[rows >= 0], doc[rows >= 0]] = impact[rows >= 0]

    @classmethod
    def of(cls, docs: list[np.ndarray], weights: np.ndarray, mean: float) -> Index:
        """The index of documents given as their ids."""
        n, lengths = len(docs), np.array([len(d) for d in docs])
        pairs = np.concatenate(docs).astype(np.int32) * n + np.repeat(np.arange(n, dtype=np.int32), lengths)  # below 2^31: n <= SHARD_DOCS
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        count = np.diff(first, append=len(pairs))
        term, doc = (x.astype(np.int64) for x in np.divmod(pairs[first], n))
        return cls(term, doc, weights[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[doc] / mean)), n)

    def only(self, kept: np.ndarray) -> Index:
        """The index of the documents where ``kept``, numbered anew."""
        some = kept[self.doc]
        return Index(self.term[some], (np.cumsum(kept) - 1)[self.doc[some]], self.impact[some], int(kept.sum()))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The score of each document for the different ids of ``query``."""
        rows = self.row[query]
        asked = np.zeros(len(self.common))
        asked[rows[rows >= 0]] = 1
        query = query[rows < 0]
        a, b = self.begin[query], self.begin[query + 1]
        sizes = b - a
        at = np.repeat(a - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n) + asked @ self.matrix


def best_unused(scores: np.ndarray, used: np.ndarray) -> Iterator[int]:
    """Unused documents from the highest score down, ties by place; sorts as many as are asked for, about."""
    free = np.flatnonzero(~used)
    some = 32
    while len(free):
        least = np.partition(scores[free], -some)[-some] if len(free) > some else -np.inf
        head = free[scores[free] >= least]
        yield from head[np.lexsort((head, -scores[head]))].tolist()
        free, some = free[scores[free] < least], 8 * some


def windows_of(docs: list[np.ndarray], index: Index, capacity: int = CAPACITY) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, from, to); all are full but perhaps the last one. Used documents leave the index now and then."""
    names, used, scan, rest = np.arange(len(docs)), np.zeros(len(docs), dtype=bool), 0, None
    while True:
        if rest is None:
            while scan < len(docs) and used[scan]:
                scan += 1
            if scan == len(docs):
                return
            used[scan], rest = True, (scan, 0, len(docs[scan]))
        window, room, rest = [rest], capacity - (rest[2] - rest[1]), None
        gone = used[names]
        if 5 * gone.sum() > len(names):
            index, names = index.only(~gone), names[~gone]
            gone = used[names]
        asked = np.zeros(VOCABULARY, dtype=bool)
        asked[docs[window[0][0]]] = True
        for near in best_unused(index.scores(np.flatnonzero(asked)), gone) if room and len(names) else ():
            other = names[near]
            used[other] = True
            size = len(docs[other])
            window.append((other, 0, min(size, room)))
            if size > room:
                rest = (other, room, size)
            room -= min(size, room)
            if not room:
                break
        yield window


def split_binary(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window that isn't full as sequences whose lengths are powers of two, the largest first."""
    left = sum(b - a for _, a, b in window)
    todo = list(window)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        part = []
        while size:
            doc, a, b = todo[0]
            take = min(size, b - a)
            part.append((doc, a, a + take))
            todo[0] = (doc, a + take, b)
            size -= take
            if a + take == b:
                todo.pop(0)
        yield part


def pack_by_retrieval(docs: DataFrame, ranks_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all (doc_id, text)."""
    spark = docs.sparkSession
    made = stored(tokenised(docs, ranks_file, with_ids).withColumn("row", F.monotonically_increasing_id()))
    weights, mean = rarity(made)
    sent = spark.sparkContext.broadcast((weights, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean = sent.value
        sequence = TaskContext.get().partitionId() << 33

        def packed(shard: list[tuple], last: bool) -> tuple[pa.RecordBatch, list[tuple]]:
            """The shard's pieces, and what its last window holds if another shard follows."""
            nonlocal sequence
            ids = [r[3] for r in shard]
            out, left = [], []
            for window in windows_of(ids, Index.of(ids, weights, mean)):
                full = sum(b - a for _, a, b in window) == CAPACITY
                if not full and not last:
                    left = [(shard[d][0], shard[d][1] + a, shard[d][2], ids[d][a:b]) for d, a, b in window]
                    continue
                for part in [window] if full else split_binary(window):
                    at = 0
                    for d, a, b in part:
                        doc, start, tokens, own = shard[d]
                        out.append((doc, start + a, b - a, _checksum(own[a:b]), tokens, sequence, at, own[a:b].tolist() if with_ids else None))
                        at += b - a
                    sequence += 1
            fields = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.list_(pa.int32()))]
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields]), left

        shard, size = [], 0
        for batch in batches:
            ids, flat = batch.column("rest").offsets.to_numpy(), batch.column("rest").values.to_numpy(zero_copy_only=False)
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), strict=True)
            for k, row in enumerate(rows):
                own = flat[ids[k] : ids[k + 1]].copy()
                if shard and (size + len(own) > SHARD_IDS or len(shard) >= SHARD_DOCS):
                    made, shard = packed(shard, last=False)
                    size = sum(len(r[3]) for r in shard)
                    yield made
                shard.append((*row, own))
                size += len(own)
        if shard:
            yield packed(shard, last=True)[0]

    start = (F.col("doc_tokens") - F.size("rest")).alias("start")
    rests = made.where(F.size("rest") > 0).select("doc_id", start, "doc_tokens", "rest", near_keys(made, weights).alias("near"), "row")
    rests = rests.repartitionByRange("near", "row").sortWithinPartitions("near", "row").drop("near", "row")
    schema = PIECE + ", ids array<int>"
    packed = rests.mapInArrow(run, schema)
    full = made.select("doc_id", "doc_tokens", *(["leading"] if with_ids else []), F.posexplode("windows").alias("k", "ids_crc32"))
    ids = F.slice("leading", F.col("k") * CAPACITY + 1, CAPACITY) if with_ids else F.lit(None).cast("array<int>")
    number = -1 - F.monotonically_increasing_id()  # sequences of one piece each have numbers below zero
    full = full.select("doc_id", (F.col("k") * F.lit(CAPACITY).cast("long")).alias("start"), F.lit(CAPACITY).cast("long").alias("length"), "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), ids.alias("ids"))
    out = packed.unionByName(full)
    return out if with_ids else out.drop("ids")


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all ``documents`` in sequences of at most 2048 tokens."""
    return pack_by_retrieval(spark.read.parquet(f"{sf_dir}/documents.parquet"))
