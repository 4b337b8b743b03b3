"""Chat formatting as prefix trees: shared first turns are emitted once.

A turn becomes a segment with marks around its role and text; control strings inside either are escaped reversibly. A node
of the forest is a sequence of first turns, named by running sums of hashes, and belongs to the conversation of the smallest
id that starts with it. A conversation's own nodes are therefore one chain that hangs on a node of another chain, and depth
first means: a chain, then the chains that hang on it, from its deepest node up, each with all that hangs on it. Every node is
emitted once with its tokens, its place in its tree's token sequence, its position id (the tokens before it on its own path)
and the intervals of ancestors' tokens that it may attend to besides its own chain.

A conversation is read back by walking the emitted trees: the intervals that its last node attends to, and its own chain up to
there, name a stretch of tokens each; the tokens of these, in the order of their offsets, are decoded and parsed.

Trees are worked out on short rows that carry hashes and token counts only. Texts are shuffled once, to meet equal turns: each
different turn is cut into tokens once, and its count of tokens joins the turns by hash. Tokens are shuffled once, to bring them to the conversations that are read back. Paths of chains to
their root are found by pointer doubling, in rounds that follow the logarithm of their depth; what one row carries grows with
the count of branchings on its path, as its list of intervals does. Running sums and joins split a hot key. The digests of
one conversation are taken in order, so its turns stream through one task; they aren't gathered.

Defined results: a null role or text is empty; turns that repeat a number follow by hashes of role and text, repeated rows are
turns of their own; turns without conv_id are dropped; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import cut, running_sum, running_sums, spread_join, stored

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates read as control strings.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNT_ROLE = "assistant"
#: Hashes that name a formatted turn.
SEGMENT = ("d1", "d2")
RANKS_FILE = "byte_bpe_50k.tiktoken"
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double backslashes, and break control strings with one after their first character."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def segment(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a formatted turn. A role's line breaks are written as a backslash and n."""
    return f"{START}{escape(role)}\n".replace("\n", "\\n", role.count("\n")), escape(text), f"{END}\n"


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, _, rest = formatted.partition("\n")
    return unescape(head[len(START) :]), unescape(rest[: -len(END) - 1])


def _encoding(ranks_file: str, pattern: str):
    import tiktoken

    lines = Path(ranks_file).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tokens(rows: DataFrame, ranks_file: str) -> DataFrame:
    """Replace role and text by ``n_tokens``, the tokens and the part of them that the loss covers."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks_file, pattern)
        for batch in batches:
            out = []
            for role, text in zip(batch["role"], batch["text"], strict=True):
                head, body, tail = segment(role, text)
                first, ids, last = (encoding.encode_to_numpy(x, disallowed_special=()) for x in (head, body, tail))
                span = (len(first), len(first) + len(ids)) if role == LEARNT_ROLE else (0, 0)
                out.append((len(first) + len(ids) + len(last), np.concatenate((first, ids, last)).astype("<u2").tobytes(), *span))
            made = pd.DataFrame(out, columns=["n_tokens", "ids", "loss_from", "loss_to"], index=batch.index)
            yield pd.concat([batch.drop(columns=["role", "text"]), made], axis=1)

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name not in ("role", "text"))
    return rows.mapInPandas(run, f"{schema}n_tokens long, ids binary, loss_from long, loss_to long")


def prefix_trees(conversations: DataFrame, ranks_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of all trees, and a walk (conv_id, owner, start, end) for each stretch of tokens of a conversation.

    Nodes: owner, idx, n_conversations, tree, offset (in the tree's tokens), position (id of the first token), n_tokens, ids
    (little-endian unsigned 16-bit numbers), loss_from and loss_to (tokens of the node), attention (ancestors' token
    intervals in the tree, outermost first).
    """
    nodes, segments, walks = prefix_forest(conversations, ranks_file)
    return nodes.join(segments.drop("n_tokens"), [*SEGMENT]).drop(*SEGMENT), walks


def prefix_forest(conversations: DataFrame, ranks_file: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``prefix_trees``, with the nodes' segments (n_tokens, ids, loss span) in a table of their own, by ``SEGMENT``."""
    import public_tokenizers

    file = ranks_file or public_tokenizers.path(RANKS_FILE)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    texts = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)
    texts = texts.withColumns({name: F.xxhash64(F.lit(seed), "role", "text") for seed, name in enumerate(SEGMENT)})
    different = texts.groupBy(*SEGMENT).agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n"))
    segments = stored(_tokens(different, file))

    counted = spread_join(texts.select("conv_id", "turn", *SEGMENT), segments.select(*SEGMENT, "n_tokens", "n"), [*SEGMENT], weight="n")
    segments = segments.drop("n")
    turns = running_sum(counted, ["conv_id"], ["turn", *SEGMENT], F.lit(1).cast("long"), "idx").drop("turn")

    def hashed(seed: int):  # 38 bits, so that sums over a conversation don't overflow
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "idx", *SEGMENT), 26)

    turns = running_sums(turns.withColumns({"h1": hashed(1), "h2": hashed(2)}), ["conv_id"], ["idx"], {"p1": F.col("h1"), "p2": F.col("h2"), "position": F.col("n_tokens")})
    key = ["idx", "p1", "p2"]
    turns = cut(turns.select("conv_id", "idx", (F.col("p1") + F.col("h1")).alias("p1"), (F.col("p2") + F.col("h2")).alias("p2"), *SEGMENT, "n_tokens", "position"))
    nodes = cut(turns.groupBy(*key).agg(F.min("conv_id").alias("owner"), *(F.first(c).alias(c) for c in (*SEGMENT, "n_tokens", "position")), F.count("*").alias("n_conversations")))
    members = spread_join(turns.select("conv_id", *key, "n_tokens", "position"), nodes.select(*key, "owner", F.col("n_conversations").alias("n")), key, weight="n")

    own = F.col("owner") == F.col("conv_id")
    talks = members.groupBy("conv_id").agg(
        F.min(F.when(own, F.col("position"))).alias("begins"), F.min(F.when(own, F.col("idx"))).alias("first"), F.sum(F.when(own, F.col("n_tokens"))).alias("tokens"),
        F.max(F.when(~own, F.struct("idx", "owner"))).alias("above"), F.max(F.struct("idx", "owner")).alias("last"), F.sum("n_tokens").alias("total"),
    )
    talks = cut(talks.select("conv_id", "begins", "first", "tokens", F.col("above.owner").alias("parent"), F.col("last.owner").alias("leaf"), "total"))

    # Chains with the steps and spans of their path; ``up`` is the chain above these, none at the root.
    step, none = F.struct((-F.col("first")).alias("first"), F.col("conv_id").alias("owner")), F.array().cast("array<struct<owner:bigint,to:bigint>>")
    above = F.when(F.col("parent").isNotNull(), F.array(F.struct(F.col("parent").alias("owner"), F.col("begins").alias("to")))).otherwise(none)
    chains = cut(talks.where("first is not null").select(F.col("conv_id").alias("owner"), "begins", "tokens", F.col("parent").alias("up"), F.array(step).alias("path"), above.alias("above")))
    while not (rising := chains.where("up is not null")).isEmpty():
        upper = chains.select(F.col("owner").alias("up"), F.col("up").alias("next"), F.col("path").alias("so_far"), F.col("above").alias("higher"))
        joined = spread_join(rising, upper, ["up"])
        risen = joined.select("owner", "begins", "tokens", F.col("next").alias("up"), F.concat("so_far", "path").alias("path"), F.concat("higher", "above").alias("above"))
        chains = cut(chains.where("up is null").unionByName(risen))
    chains = chains.withColumn("tree", F.get("path", F.lit(0))["owner"])
    laid = cut(running_sum(chains.select("owner", "tree", "begins", "tokens", "path", "above"), ["tree"], ["path"], F.col("tokens"), "offset").drop("path", "tokens"))

    starts = laid.select("owner", "offset", "begins")
    spans = cut(laid.select(F.col("owner").alias("chain"), F.posexplode("above").alias("k", "x")).select("chain", "k", "x.owner", "x.to"))
    span = F.struct("k", "owner", F.col("offset").alias("start"), (F.col("offset") + F.col("to") - F.col("begins")).alias("end"))
    spans = spread_join(spans, starts, ["owner"]).groupBy(F.col("chain").alias("owner")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = cut(laid.select("owner", "tree", "offset", "begins").join(spans, "owner", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<k:int,owner:bigint,start:bigint,end:bigint>>"))))

    at = spans.select("owner", "tree", F.col("offset").alias("chain_offset"), "begins", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("attention"))
    nodes = spread_join(nodes.drop("p1", "p2"), at, ["owner"])
    nodes = nodes.withColumn("offset", F.col("chain_offset") + F.col("position") - F.col("begins")).drop("chain_offset", "begins")

    last = F.struct(F.size("spans").alias("k"), F.col("leaf").alias("owner"), F.col("offset").alias("start"), (F.col("offset") + F.col("total") - F.col("begins")).alias("end"))
    leaves = spread_join(talks.select("conv_id", "leaf", "total"), spans.withColumnRenamed("owner", "leaf"), ["leaf"])
    walks = cut(leaves.select("conv_id", F.explode(F.concat("spans", F.array(last))).alias("x")).select("conv_id", "x.owner", "x.start", "x.end"))
    return nodes, segments, walks


def read_back(nodes: DataFrame, segments: DataFrame, walks: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """Digests of each conversation, from the emitted tokens that its walk names. Conversations stream through.

    ``nodes`` name their segments by ``SEGMENT``. Only owner, offset, n_tokens and the names are read of them.
    """
    import public_tokenizers

    file, pattern = ranks_file or public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(file, pattern)
        now, state = None, None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for conv, ids, start, end in zip(batch["conv_id"], batch["ids"], batch["loss_from"], batch["loss_to"], strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(ids, "<u2").tolist()
                formatted = encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")
                role, text = parse(formatted)
                learnt = unescape(encoding.decode_bytes(ids[start:end]).decode("utf-8", "surrogatepass"))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if out:
                yield frame(out)
        if state is not None:
            yield frame([row()])

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    stream = nodes.select("owner", "offset", (F.col("offset") + F.col("n_tokens")).alias("upto"), *SEGMENT)
    steps = spread_join(walks, stream, ["owner"]).where("offset >= start and upto <= end").select("conv_id", "offset", *SEGMENT)
    turns = spread_join(cut(steps), segments.select(*SEGMENT, "ids", "loss_from", "loss_to"), [*SEGMENT])
    turns = turns.select("conv_id", "offset", "ids", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "offset")
    return turns.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted as prefix trees and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    asked = "</s>[INST] ok [/INST]"
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", asked), (-7, 1, "assistant", asked)], rows.schema)
    return read_back(*prefix_forest(rows.unionByName(more)))
