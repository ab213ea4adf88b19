"""Quality classifier: supervised subword embeddings, averaged per document, under a softmax; trained by numpy SGD.

A word's features are the word itself and its character n-grams, hashed into a table of embeddings; a word that repeats
the one before it adds the feature ``REPEAT``. A document is the mean of the embeddings of all features, ``EMPTY`` blank
ones included, so that a few words do not decide alone. As the softmax is linear in that mean, scoring needs one number
and one count per word, which workers remember, so whole texts of any length are read once. Long words, such as texts
without spaces, hardly come again: their n-grams are counted in pieces where they are, and not remembered.

Defined results. A null or empty text has no features and gets the score of the bias alone (as do blank features). Labels other than 0 and 1, null
ones, and labels of unknown documents teach nothing; with labels of one class only, or none, every score is 1 or the prior 0.5. Repeated
rows each get their row. Empty tables give empty tables. Extra columns pass through; ``score`` replaces a column of
that name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, give_back, table

#: Labelled rows that a model is fitted on, at most: the first by a hash of the identifier.
MAX_LABELLED = 4000
THRESHOLD = 0.3
FOLDS = 5
#: Words that a worker remembers; it forgets them all beyond that.
CACHE_WORDS = 200_000
#: Lengths of n-grams, which are taken of whole words.
LOW, HIGH = 2, 4
#: Words of more characters are not remembered, and read so many bytes at a time; results do not depend on either.
REMEMBERED, PIECE = 64, 1 << 16
#: Feature of a word that follows itself, as often as a short word has features; blank features of every document.
REPEAT, REPEAT_TIMES, EMPTY = 0, 10, 150


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text, modulo 5, is 0; a null identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(words: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, slot) of every feature of the words: itself, and the n-grams of its bytes between < and >."""
    own = slots - 1  # slot 0 is REPEAT
    data = [f"<{w}>".encode() for w in words]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # bytes up to the word's end
    which = [np.arange(len(words))]
    at = [np.array([zlib.crc32(w.encode()) for w in words], dtype=np.int64) % own + 1]
    for n in range(LOW, HIGH + 1):
        fit = np.flatnonzero(left >= n)
        which.append(word[fit])
        at.append(gram_slots(flat, fit, n, own))
    return np.concatenate(which), np.concatenate(at)


def gram_slots(flat: np.ndarray, begin: np.ndarray, n: int, own: int) -> np.ndarray:
    """Slots of the n-grams of bytes that begin at these places."""
    gram = np.full(len(begin), n, dtype=np.uint64)
    for k in range(n):
        gram = gram << np.uint64(8) | flat[begin + k]
    mixed = gram * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(own)).astype(np.int64) + 1


def long_features(word: str, slots: int) -> Iterator[np.ndarray]:
    """The slots of all features of one word, as features() has them, in pieces of bounded size."""
    own = slots - 1
    yield np.array([zlib.crc32(word.encode()) % own + 1])
    data = np.frombuffer(f"<{word}>".encode(), np.uint8)
    for begin in range(0, len(data), PIECE):
        for n in range(LOW, HIGH + 1):
            flat = data[begin : begin + PIECE + n - 1].astype(np.uint64)
            yield gram_slots(flat, np.arange(max(0, len(flat) - n + 1)), n, own)


@dataclass(frozen=True)
class Model:
    """What scoring needs of the embeddings: each slot's embedding times the difference of the output weights."""

    slots: np.ndarray
    bias: float


def train(texts: list[str], labels: np.ndarray, bits: int = 17, dim: int = 8, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time, over shuffled documents with a falling rate."""
    slots = 1 << bits
    if not len(texts) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(slots, np.float32), 40.0 if len(labels) and labels[0] else -40.0 if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    cut = []
    for t in texts:
        words = (t or "").split()
        cut.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    slot, many = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    every = list(number)
    del number
    long = {i: w for i, w in enumerate(every) if len(w) > REMEMBERED}
    is_long = np.zeros(len(every), dtype=bool)
    is_long[list(long)] = True
    for k in range(0, len(every), 20_000):
        short = np.flatnonzero(~is_long[k : k + 20_000])
        which, at = features([every[k + i] for i in short], slots)
        which = short[which]
        slot.append(at[np.argsort(which, kind="stable")].astype(np.int32))
        many.append(np.bincount(which, minlength=len(every[k : k + 20_000])))
    del every
    slot, many = np.concatenate(slot), np.concatenate(many)
    begin = np.cumsum(many) - many
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for w in cut:
        again = REPEAT_TIMES * int((w[1:] == w[:-1]).sum())
        # each word once, with how often it is there
        w, times = np.unique(w, return_counts=True)
        n = many[w]
        found = slot[np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.bincount(np.append(found, REPEAT), np.append(np.repeat(times, n), again), slots)
        for i, often in zip(w[is_long[w]].tolist(), times[is_long[w]].tolist(), strict=True):
            for at in long_features(long[i], slots):
                np.add.at(total, at, float(often))
        at = np.flatnonzero(total).astype(np.int32)
        docs.append((at, (total[at] / (total.sum() + EMPTY)).astype(np.float32)))
    table_ = rng.uniform(-1 / dim, 1 / dim, (slots, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            at, share = docs[k]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ table_[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * p
            # shares are small: a document's features move as its mean does
            table_[at] -= (lr * np.minimum(1, share * len(at)))[:, None] * back[None, :]
    return Model(table_ @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def sample(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> pd.DataFrame:
    """At most ``most`` labelled texts whose identifier is not held out, the first by a hash of it."""
    rows = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull() & ~held_out(F.col(f"`{key}`")))
    rows = rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label")).distinct()
    rows = rows.orderBy(F.md5(F.col("_key").cast("string")), "_key", "_label").limit(most)  # bounded, so it may be broadcast
    found = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")).join(F.broadcast(rows), "_key")
    return found.orderBy(F.md5(F.col("_key").cast("string")), F.md5(F.coalesce("_text", F.lit(""))), "_label").limit(2 * most).toPandas()


class Scorer:
    """Probabilities of label 1 for whole texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.values, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def _number(self, words: list[str]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        if words:
            which, at = features(words, len(self.model.slots))
            self._number(words)
            self.values = np.append(self.values, np.bincount(which, self.model.slots[at], len(words)))
            self.counts = np.append(self.counts, np.bincount(which, minlength=len(words)))

    def _long(self, word: str) -> tuple[float, int]:
        value, count = 0.0, 0
        for at in long_features(word, len(self.model.slots)):
            value, count = value + float(self.model.slots[at].sum(dtype=np.float64)), count + len(at)
        return value, count

    def scores(self, texts: pd.Series) -> np.ndarray:
        out = np.zeros(len(texts))
        if len(self.known) > CACHE_WORDS:
            self.known, self.values, self.counts = {}, np.zeros(0), np.zeros(0, np.int64)
        rows = [(t or "").split() for t in texts]
        new = [w for w in {w for row in rows for w in row} if w not in self.known]
        self._learn([w for w in new if len(w) <= REMEMBERED])
        # long words have numbers for these texts only
        long = [w for w in new if len(w) > REMEMBERED]
        self._number(long)
        found = [self._long(w) for w in long]
        values, counts = np.append(self.values, [v for v, _ in found]), np.append(self.counts, np.array([c for _, c in found], dtype=np.int64))
        for k, words in enumerate(rows):
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                again = REPEAT_TIMES * int((at[1:] == at[:-1]).sum())
                out[k] = (values[at].sum() + again * float(self.model.slots[REPEAT])) / (counts[at].sum() + again + EMPTY)
        for w in long:
            del self.known[w]
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -40, 40)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> Model:
    rows = sample(documents, labels, label, key, text, most)
    return train(rows["_text"].tolist(), rows["_label"].to_numpy())


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``score``, the probability of label 1."""
    spark = documents.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in parts:
            yield pd.Series(scorer.scores(texts))
        del scorer
        give_back()

    return documents.withColumn("score", F.pandas_udf(apply, "double")(F.col(f"`{text}`").cast("string")))


def good(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return score(whole, model).where(F.col("score") >= threshold).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
