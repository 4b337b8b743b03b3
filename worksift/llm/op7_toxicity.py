"""Toxicity scores with noisy-channel deobfuscation.

Suspicious tokens (letters mixed with look-alike digits or signs, letters set apart by signs, letters repeated three times or
more, runs of single letters) are read as a lattice of characters: each place may be itself, a letter that it looks
like, a separator to skip, or a repetition to collapse. Viterbi decoding picks the reading that a character model and the
channel's costs prefer, in a run of single characters also the places where words end; the restored word is scored as if it had been written plainly. All other tokens are read as they are.

The character model counts trigrams over every document, without stretched words. The classifier learns on a bounded sample of ``TRAIN_ROWS``
labelled rows: log-odds of words and of word beginnings that are significantly tied to the label, and a logistic curve over
the two strongest of a document and their mean. Only the text is an input of a score.

Defined results: null or empty texts get the score of a text without evidence; labels without a document teach nothing;
repeated rows are scored each; null doc_ids are never used to learn; extra columns are carried along, but for ``score`` and
``predicted``, which are replaced; without labels of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.llm.common import stored


#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: A feature needs this many toxic documents and this many standard errors above chance.
MIN_TOXIC, MIN_Z = 5, 5.0
PREFIXES = (4, 5, 6)
#: Letters that digits and signs look like.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "§": "s",
}
SEPARATORS = ".-_*~'`^/\\ ,"
_STRIP = "#*$%&|<>.,;:!?\"'()[]{}«»“”…-–—_~"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Natural-log costs of the channel: a look-alike, a skipped separator, a repetition collapsed in a run of three or
#: more and in a pair, a kept odd character.
COST_LOOK, COST_SKIP, COST_REPEAT, COST_PAIR, COST_ODD = 1.5, 0.7, 0.7, 4.0, 12.0
_REPEATED = re.compile(r"(.)\1\1")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class CharacterModel:
    """Interpolated trigrams over a-z, one class for other letters (1) and the word's edge (0)."""

    SIZE = 28

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        tri = counts.reshape(self.SIZE, self.SIZE, self.SIZE).astype(float)
        bi, one = tri.sum(0), tri.sum((0, 1))
        p1 = (one + 1) / (one.sum() + self.SIZE)
        p2 = (bi + 10 * p1) / (bi.sum(1, keepdims=True) + 10)
        self.log = np.log((tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10)).tolist()

    @staticmethod
    def code(letter: str) -> int:
        return ord(letter) - 95 if "a" <= letter <= "z" else 1

    @classmethod
    def count(cls, words: dict[str, int]) -> np.ndarray:
        out = np.zeros(cls.SIZE**3, np.int64)
        for word, n in words.items():
            a = b = 0
            for c in [*map(cls.code, word), 0]:
                out[(a * cls.SIZE + b) * cls.SIZE + c] += n
                a, b = b, c
        return out

    def decode(self, token: str, breaks: bool = False) -> str:
        """The likeliest reading of a lower-case ``token``: exact Viterbi over all states, linear in the token's length.

        The state is the last two letters' classes and the last place's letter. With ``breaks`` a word may end between any two
        places, and the reading's words are set apart by blanks.
        """
        states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        for at, sign in enumerate(token):
            stretched = token[max(0, at - 2) : at + 3].count(sign) >= 3
            options = [(sign, 0.0 if sign in _LETTERS or sign.isalpha() else COST_ODD)]
            options += [(x, COST_LOOK) for x in LOOKALIKES.get(sign, "")]
            if breaks and at:
                ended = ((score + self.log[a][b][0], (path, " ")) for (a, b, _), (score, path) in states.items() if b)
                states[0, 0, ""] = max([*ended, *(x for key, x in states.items() if key == (0, 0, ""))], key=lambda x: x[0])
            new: dict[tuple[int, int, str], tuple[float, tuple]] = {}
            for (a, b, last), (score, text) in states.items():
                moves = []
                for letter, cost in options:
                    c = self.code(letter)
                    moves.append(((b, c, letter), score + self.log[a][b][c] - cost, (text, letter)))
                    if letter == last:
                        moves.append(((a, b, last), score - cost - (COST_REPEAT if stretched else COST_PAIR), text))
                if sign in SEPARATORS:
                    moves.append(((a, b, last), score - COST_SKIP, text))
                for key, value, path in moves:
                    if key not in new or value > new[key][0]:
                        new[key] = (value, path)
            states = new
        path, letters = max(((score + self.log[a][b][0], path) for (a, b, _), (score, path) in states.items()), key=lambda x: x[0], default=(0, ()))[1], []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))


def core(token: str) -> str:
    return token.lower().strip(_STRIP)


def readings(token: str, model: CharacterModel | None) -> list[str]:
    """The words a token may stand for: itself, and if it looks disguised its likeliest reading."""
    plain = core(token)
    if plain.isalpha() and not _REPEATED.search(plain):
        return [plain]
    raw = token.lower().strip(".,;:?\"'")
    letters = sum(map(str.isalpha, raw))
    strange = sum(x in LOOKALIKES or x in SEPARATORS for x in plain)
    if model is None or len(raw) < 3 or not letters or (strange == 0 and not _REPEATED.search(plain)) or letters + strange < len(plain):
        return [plain] if plain else []
    read = {model.decode(plain)}
    if raw != plain and any(x in LOOKALIKES for x in (raw[:1], raw[-1:])):
        read.add(model.decode(raw.strip("#%&<>")))
    return [plain, *(x for x in sorted(read) if x and x != plain)]


def spaced_words(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, each joined to one token, which may hold several words."""
    out, run = [], []
    for token in [*tokens, "  "]:
        if len(token) == 1 and (token.isalpha() or token in LOOKALIKES):
            run.append(token)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def features_of(word: str) -> list[str]:
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


class Reader:
    """Features of a text; what tokens read as is remembered, for up to ``limit`` tokens."""

    def __init__(self, model: CharacterModel | None, wanted: dict[str, float] | None = None, limit: int = 300_000):
        self.model, self.wanted, self.limit = model, wanted, limit
        self.known: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            names = (x for word in readings(token, self.model) for x in features_of(word))
            found = tuple(dict.fromkeys(x for x in names if self.wanted is None or x in self.wanted))
            if len(self.known) < self.limit:
                self.known[token] = found
        return found

    def run(self, run: str) -> tuple[str, ...]:
        """Features of a run of single characters: of the whole as one token, and of the words that it is split into."""
        if self.model is None:
            return self.token(run)
        key = f" {run}"
        found = self.known.get(key)
        if found is None:
            names = (x for word in self.model.decode(run.lower(), breaks=True).split() for x in features_of(word))
            found = tuple(dict.fromkeys([*self.token(run), *(x for x in names if self.wanted is None or x in self.wanted)]))
            if len(self.known) < self.limit:
                self.known[key] = found
        return found

    def text(self, text: str | None) -> set[str]:
        tokens = (text or "").split()
        different = set(tokens)
        runs = set(spaced_words(tokens)) if sum(len(x) == 1 for x in different) >= 2 else ()
        return {name for token in different for name in self.token(token)}.union(*map(self.run, runs))


def evidence(found: set[str], weights: dict[str, float]) -> tuple[float, float, float]:
    """The strongest two weights, and the mean of the strongest five with missing ones as 0."""
    best = sorted((weights[x] for x in found), reverse=True)[:5]
    best += [0.0] * (5 - len(best))
    return best[0], best[1], sum(best) / 5


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the intercept comes last and is free."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-9])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def character_model(docs: DataFrame) -> CharacterModel:
    """Trigrams of all words of all documents: each task sums its own, and 28^3 sums at most reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = np.zeros(CharacterModel.SIZE**3, np.int64), Counter()
        for batch in batches:
            for text in batch["text"]:
                words.update((text or "").split())
            if len(words) > 200_000:
                total, words = total + counted(words), Counter()
        total += counted(words)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    def counted(words: Counter) -> np.ndarray:
        plain: Counter = Counter()
        for token, n in words.items():
            if (word := core(token)).isalpha() and not _REPEATED.search(word):
                plain[word] += n
        return CharacterModel.count(plain)

    rows = docs.select(F.col("text").cast("string")).mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CharacterModel.SIZE**3, np.int64)
    for row in rows:
        counts[row["at"]] = row["n"]
    return CharacterModel(counts)


def fit(docs: DataFrame, labels: DataFrame, model: CharacterModel, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray | None]:
    """Weights of features, and the logistic curve's coefficients, from rows that aren't held out."""
    taught = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id")))
    taught = taught.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounds what is broadcast
    # Three passes read the sample, so its texts are stored once.
    sample = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taught), "doc_id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts = Reader(model), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts[toxic][""] += 1
                counts[toxic].update(reader.text(text))
        names = list(counts[1])
        if counts[0][""]:
            names = list(dict.fromkeys([*names, ""]))
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            yield pd.DataFrame({"name": part, "n0": [counts[0][x] for x in part], "n1": [counts[1][x] for x in part]})

    def count_clean(names: set[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, counts = Reader(model, dict.fromkeys(names, 0.0)), Counter()
            for batch in batches:
                for text in batch["text"]:
                    counts[""] += 1
                    counts.update(reader.text(text))
            if counts:
                yield pd.DataFrame({"name": list(counts), "n0": list(counts.values())})

        return run

    # Candidates come from toxic rows alone; their counts in clean rows follow for these only.
    toxic = sample.where("toxic = 1").mapInPandas(count, "name string, n0 long, n1 long").groupBy("name").agg(F.sum("n1").alias("n1"))
    top = toxic.where(F.col("n1") >= MIN_TOXIC).collect()  # words of at most train_rows documents
    n1 = {r["name"]: r["n1"] for r in top}
    total1 = n1.pop("", 0)
    clean = sample.where("toxic = 0").mapInPandas(count_clean(set(n1)), "name string, n0 long").groupBy("name").agg(F.sum("n0").alias("n0"))
    n0 = {r["name"]: r["n0"] for r in clean.collect()}  # the same names
    total0 = n0.pop("", 0)
    if not total0 or not total1:
        return {}, None
    scored = []
    for name, a in n1.items():
        b = n0.get(name, 0)
        chance = (a + b) * total1 / (total0 + total1)
        z = (a - chance) / math.sqrt(chance)
        if z >= MIN_Z:
            scored.append((z, name, math.log((a + 0.5) / (total1 + 1)) - math.log((b + 0.5) / (total0 + 1))))
    weights = {name: weight for _, name, weight in scored}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model, weights)
        for batch in batches:
            rows = [evidence(reader.text(x), weights) for x in batch["text"]]
            yield pd.DataFrame(rows, columns=["x1", "x2", "x3"]).assign(y=batch["toxic"].to_numpy())

    seen = sample.mapInPandas(measure, "x1 double, x2 double, x3 double, y int").toPandas()  # at most train_rows rows of numbers
    return weights, _logistic(seen[["x1", "x2", "x3"]].to_numpy(), seen["y"].to_numpy(float))


def scores(docs: DataFrame, model: CharacterModel, weights: dict[str, float], beta: np.ndarray | None) -> DataFrame:
    """(all columns but the text, score, predicted): texts go to Python and don't come back."""
    sent = docs.sparkSession.sparkContext.broadcast((model.counts, weights, beta))
    kept = [f for f in docs.schema if f.name not in ("text", "score", "predicted")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, weights, beta = sent.value
        reader = Reader(CharacterModel(counts), weights)
        for batch in batches:
            rows = np.array([evidence(reader.text(x), weights) for x in batch["text"]]).reshape(-1, 3)
            score = np.zeros(len(rows)) if beta is None else 1 / (1 + np.exp(-np.clip(np.column_stack([rows, np.ones(len(rows))]) @ beta, -30, 30)))
            yield batch.drop(columns="text").assign(score=score, predicted=(score >= THRESHOLD).astype("int32"))

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.select(*(f"`{f.name}`" for f in kept), F.col("text").cast("string")).mapInPandas(run, f"{schema}score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The columns of ``docs`` but its text, with score and predicted, for each row."""
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    model = character_model(docs)
    return scores(docs, model, *fit(docs, labels, model, train_rows))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    scored = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
