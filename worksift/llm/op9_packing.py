"""Best-fit packing of token sequences by large-item matching.

Texts become token ids plus an end id. Longer ones are cut into pieces of ``CAPACITY`` after a first piece with the rest.
Pieces above a third of the capacity pair at most twice per bin: from the largest down, each meets the largest partner
that still fits. Smaller pieces then go, from the largest down, into the fullest bin that has room (best fit).

A bin's fate depends on lengths alone, so the plan is made from the count of pieces of each length: at most ``CAPACITY``
numbers, whatever the size of the corpus, and it is one global best fit rather than one for each partition. The plan
says which ranks of a length go to which run of bins; it is bounded by the capacity too, and is what is broadcast.
Ranks come from a running sum that splits a length which a third of all pieces may share.

Ids are those of ``byte_bpe_50k.json``; they are computed by tiktoken from ``byte_bpe_50k.tiktoken``, the same
vocabulary as ranks, at a quarter of the CPU time. The tests hold both against each other. As the tokenizer reads it, the
string of the special token in a text is that token.

Defined results: a null text is empty and is the end id alone; repeated rows are packed each; a null doc_id
is carried along; ``pieces`` ignores extra columns, ``pack`` carries them along but for ``sequence_id`` and ``offset``,
which it replaces; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, fresh, running_sum

CAPACITY, END_ID = 1024, 2
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Documents whose pieces a task holds at once.
BATCH = 256
#: Fixed value: the vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids, cut into pieces of at most ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers; leave them out where only their places and checksums matter.
    """
    import public_tokenizers

    path, pattern = ranks_file or public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
        parts = (whole.iloc[at : at + BATCH] for whole in batches for at in range(0, len(whole), BATCH))
        for batch in parts:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encoding.encode_to_numpy(text or "", allowed_special="all"), END_ID).astype("<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                for k, end in enumerate(ends):
                    start = ends[k - 1] if k else 0
                    part = ids[start:end].tobytes()
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part), part))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": batch["doc_id"].dtype})
            yield out if with_ids else out.drop(columns="ids")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, rank, count, bin, each, offset) for ``counts`` pieces of each length.

    Piece number r of a length, counted from 0, belongs to the placement with rank <= r < rank + count. It goes to bin
    ``bin + (r - rank) // each`` at ``offset + (r - rank) % each * length``.
    """
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    bins, out = 0, []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins (first, count)

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], count, first, each, offset))
        used[length] += count
        left[length] -= count

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        for mate in (x for x in large if x <= min(length, capacity - length)):
            n = left[length] // 2 if mate == length else min(left[length], left[mate])
            if n:
                place(length, n, bins, 1, 0)
                place(mate, n, bins, 1, length)
                gaps.setdefault(capacity - length - mate, []).append((bins, n))
                bins += n
        if n := left[length]:
            place(length, n, bins, 1, 0)
            gaps.setdefault(capacity - length, []).append((bins, n))
            bins += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        for gap in sorted(x for x in gaps if x >= length):
            each, runs, kept = gap // length, gaps.pop(gap), []
            for k, (first, n) in enumerate(runs):
                if not left[length]:
                    kept += runs[k:]
                    break
                full = min(n, left[length] // each)
                if full:
                    place(length, full * each, first, each, capacity - gap)
                    gaps.setdefault(gap - each * length, []).append((first, full))
                if full < n and left[length]:
                    some = left[length]  # fewer than fill the next bin
                    place(length, some, first + full, some, capacity - gap)
                    gaps.setdefault(gap - some * length, []).append((first + full, 1))
                    full += 1
                if full < n:
                    kept.append((first + full, n - full))
            if kept:
                gaps.setdefault(gap, []).extend(kept)
            if not left[length]:
                break
        if n := left[length]:
            each = capacity // length
            full, rest = divmod(n, each)
            if full:
                place(length, full * each, bins, each, 0)
                gaps.setdefault(capacity - each * length, []).append((bins, full))
            if rest:
                place(length, rest, bins + full, rest, 0)
                gaps.setdefault(capacity - rest * length, []).append((bins + full, 1))
            bins += full + bool(rest)
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, length, ...). ``cut_pieces`` should be materialised: it is read twice."""
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    placed = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(placed)

    cut_pieces = cut_pieces.drop("sequence_id", "offset")
    rank, order = fresh(cut_pieces, "rank")[0], [c for c in ("doc_id", "piece", "ids_crc32") if c in cut_pieces.columns]
    ranked = running_sum(cut_pieces, ["length"], order, F.lit(1).cast("long"), rank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            ranks = batch[rank].to_numpy()
            row = table[np.searchsorted(keys, (batch["length"].to_numpy() << 44) + ranks, "right") - 1]
            k = ranks - row[:, 1]
            yield batch.drop(columns=rank).assign(sequence_id=row[:, 3] + k // row[:, 4], offset=row[:, 5] + k % row[:, 4] * row[:, 0])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.select(*cut_pieces.columns, rank).mapInPandas(run, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, lengths, ids): the packed rows themselves, from pieces that carry ``ids``."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    out = placed.groupBy("sequence_id").agg(rows.alias("rows"))
    return out.select("sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.length").alias("lengths"), F.aggregate("rows", F.lit(b""), lambda got, x: F.concat(got, x["ids"])).alias("ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all ``documents`` in sequences of at most 1024 tokens."""
    return pack(cut(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)))
