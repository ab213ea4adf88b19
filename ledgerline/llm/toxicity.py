"""Toxicity by a classifier chain: categories are predicted one after another by linear models on hashed words, and each
model also sees the probabilities of the categories before it.

While training, those probabilities come from models that did not see the row (out of folds), so that a later model
learns from predictions as it will meet them. Words and runs of signs are features by presence. A model uses the slots
whose presence and label are dependent beyond chance (likelihood ratio of at least ``LEAST_G``), since a corpus has far
more rare words than labels.

Categories are 0/1 columns of the label table in chain order; a name that begins with ``-`` takes the opposite. The
default chain, ``-quality`` then ``toxic``, is all that the labels of the corpus tell.

Defined results. A null or empty text has no words and gets the probabilities of the biases. Labels other than 0 and 1 teach nothing.
Without labels, or with labels of one class, a category's probability is the share of ones (0 without labels). Repeated
rows each get their row. Empty tables give empty tables. Extra columns pass through; output columns replace columns of
the same names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, table

CHAIN = ("-quality", "toxic")
#: Labelled rows that the chain is fitted on, at most: the first by a hash of the identifier.
MAX_LABELLED = 8000
SLOTS = 1 << 18
FOLDS = 4
#: Of a chi-squared variable with one degree of freedom: one slot in 20 million exceeds it by chance.
LEAST_G = 30.0
THRESHOLD = 0.5
CACHE_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")


def slot_of(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


class Words:
    """Slots of the distinct words of texts; words seen before are remembered, in bounded number."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def slots(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = slot_of(w)
        return np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))


@dataclass(frozen=True)
class Link:
    """One category's model: a weight per slot, per earlier category, and a bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums + before @ self.earlier + self.bias, -40, 40)))


def _sums(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[r].sum() for r in rows], dtype=float)


def telling(ones: np.ndarray, texts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which slots have a likelihood ratio of at least LEAST_G; ones and texts: how many texts with label 1, and in all."""
    n, n1 = len(y), y.sum()
    g = np.zeros(len(texts))
    for seen, total in ((ones, n1), (texts - ones, n - n1)):
        for k, share in ((seen, texts / n), (total - seen, 1 - texts / n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(k > 0, 2 * k * np.log(k / (total * share)), 0)
    return g >= LEAST_G


def fit_link(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60, rate: float = 0.5) -> Link:
    """Logistic regression by full-batch Adagrad; labels of one class give a constant."""
    weights, earlier = np.zeros(SLOTS), np.zeros(before.shape[1])
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Link(weights, earlier, 40.0 if share else -40.0)
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    often = telling(np.bincount(flat, y[which], SLOTS), np.bincount(flat, minlength=SLOTS), y)
    keep = often[flat]
    which, flat = which[keep], flat[keep]
    bias = float(np.log(share / (1 - share)))
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    g_w, g_e, g_b = np.full(SLOTS, 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(which, weights[flat], len(y)) + before @ earlier + bias
        error = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        d_w, d_e, d_b = np.bincount(flat, error[which], SLOTS) + l2 * weights / 100, before.T @ error + l2 * earlier, float(error.sum())
        g_w, g_e, g_b = g_w + d_w**2, g_e + d_e**2, g_b + d_b**2
        weights -= rate * np.where(often, d_w / np.sqrt(g_w), 0)
        earlier -= rate * d_e / np.sqrt(g_e)
        bias -= rate * d_b / np.sqrt(g_b)
    return Link(weights, earlier, bias)


def slots_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    words = Words()
    for texts in parts:
        yield pd.Series([words.slots(t) for t in texts], dtype=object)


def train(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """The chain for 0/1 labels, a column per category; -1 where unknown."""
    words = Words()
    return train_rows([words.slots(t) for t in texts], labels, folds)


def train_rows(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """The same from the texts' slots, which are bounded in number where texts are not."""
    fold = np.arange(len(rows)) % folds
    before = np.zeros((len(rows), 0))
    chain: list[Link] = []
    for c in range(labels.shape[1]):
        known = labels[:, c] >= 0
        pick = lambda use: ([rows[i] for i in np.flatnonzero(use)], before[use], labels[use, c].astype(float))  # noqa: B023, E731
        chain.append(fit_link(*pick(known)))
        guess = np.zeros(len(rows))
        for f in range(folds if c + 1 < labels.shape[1] else 0):
            unseen = fold == f
            link = fit_link(*pick(known & ~unseen))
            guess[unseen] = link.probability(_sums([rows[i] for i in np.flatnonzero(unseen)], link.weights), before[unseen])
        before = np.column_stack([before, guess])
    return chain


def fit(documents: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, key: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> list[Link]:
    value = lambda c: F.when(~F.coalesce(F.col(f"`{c.lstrip('-')}`").isin(0, 1), F.lit(False)), -1).otherwise((1 - F.col(f"`{c[1:]}`")) if c[0] == "-" else F.col(f"`{c}`")).cast("int")
    rows = labels.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"), F.array(*[value(c) for c in chain]).alias("_y")).distinct()
    rows = rows.orderBy(F.md5(F.col("_key").cast("string")), "_key", "_y").limit(most)  # bounded, so it may be broadcast
    found = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")).join(F.broadcast(rows), "_key")
    # the slots of the distinct words come to the driver, not the texts
    bound_batches(documents.sparkSession)
    found = found.withColumn("_order", F.md5(F.coalesce("_text", F.lit("")))).withColumn("_slots", F.pandas_udf(slots_of, "array<int>")("_text")).drop("_text")
    found = found.orderBy(F.md5(F.col("_key").cast("string")), "_order", "_y").limit(2 * most).select("_y", "_slots").toPandas()
    y = np.array(found["_y"].tolist(), dtype=np.int64).reshape(len(found), len(chain))
    return train_rows([np.asarray(x, dtype=np.int64) for x in found["_slots"]], y)


def score(documents: DataFrame, links: list[Link], chain: tuple[str, ...] = CHAIN, text: str = "text") -> DataFrame:
    """``documents`` with a column ``p_<category>`` for each category of the chain (``p_not_<column>`` for opposites)."""
    spark = documents.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(links)
    names = [f"p_not_{c[1:]}" if c[0] == "-" else f"p_{c}" for c in chain]

    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for texts in parts:
            rows = [words.slots(t) for t in texts]
            before = np.zeros((len(rows), 0))
            for link in shared.value:
                before = np.column_stack([before, link.probability(_sums(rows, link.weights), before)])
            yield pd.DataFrame(before, columns=names)

    udf = F.pandas_udf(apply, ", ".join(f"{n} double" for n in names))
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in names]
    scored = documents.select(*rest, udf(F.col(f"`{text}`").cast("string")).alias("_p"))
    return scored.select(*rest, *[F.col("_p")[n].alias(n) for n in names])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    links = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, links).select("doc_id", "p_not_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
