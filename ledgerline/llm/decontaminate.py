"""Benchmark decontamination: which words of a document lie in passages of benchmark items.

A window is ``WINDOW`` consecutive words of an item, or a whole item of fewer. Windows are found by a prefix-filtered
join: the corpus-wide document frequency of every shingle of a window orders its shingles by rarity; as a window must be
contained whole, one shingle, the rarest, is a sufficient prefix. Documents are probed for prefix shingles only; a
probe that lies too near the start or the end for its window (position and length bounds) goes, the rest is compared word
by word.

The benchmark is cut into blocks of about ``max_rows`` (window, item) rows. Each block is counted and probed by a scan
of the documents of its own, so that what is broadcast is bounded whatever the benchmark's size; only hits are written
between blocks.

Defined results. A null text has no words and no hits. An item without words has no windows; hits of an item with a null
id count, but it is not listed. Repeated documents each get their row, repeated items count once. Empty tables give no
hits. Extra columns pass through; output columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, checkpoint, scratch, table

WINDOW = 10
SHINGLE = 3
#: (window, item) rows of the benchmark that are broadcast at a time: some 30 MB.
MAX_ROWS = 100_000
BITS = 21

_kept = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
#: Bytes of UTF-8 to lower-case letters, digits and what is beyond ASCII; all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _kept else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def windows_of(text: str | None, size: int = WINDOW) -> Iterator[bytes]:
    words = words_of(text)
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield b" ".join(words[i : i + size])


def window_rows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct (item, window) rows."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, w.decode()) for i, t in zip(part["item"], part["text"], strict=True) for w in windows_of(t, size)]
            yield pd.DataFrame(rows, columns=["item", "window"], dtype=object)

    narrow = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInPandas(cut, "item string, window string").distinct()


class Block:
    """Some windows of the benchmark, as word numbers, with the shingles they are looked up by."""

    def __init__(self, rows: list[tuple[str | None, str]]) -> None:
        self.words: dict[bytes, int] = {}
        known: dict[str, int] = {}
        items: list[list[str]] = []
        for item, window in sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0])):
            k = known.setdefault(window, len(known))
            if k == len(items):
                items.append([])
            if item is not None:
                items[k].append(item)
        cut = [w.encode().split() for w in known]
        width = max(map(len, cut), default=1)
        self.items = items
        self.lengths = np.array([len(w) for w in cut], dtype=np.int64)
        self.window = np.full((len(cut), width), -1, dtype=np.int32)
        for k, w in enumerate(cut):
            self.window[k, : len(w)] = [self.words.setdefault(x, len(self.words)) for x in w]
        self.sizes = sorted({min(SHINGLE, n) for n in self.lengths.tolist()})
        # every shingle of every window: its number, window and offset
        at: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in self.sizes:
            own = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == size)
            for o in range(width - size + 1):
                fit = own[self.lengths[own] >= o + size]
                at.append((self._numbers(self.window[fit, o : o + size].T), fit, np.full(len(fit), o)))
        self._at = tuple(np.concatenate(x) if at else np.zeros(0, np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 3
        self.shingles = np.unique(self._at[0])

    @staticmethod
    def _numbers(columns: np.ndarray) -> np.ndarray:
        """One number for each shingle; exact, for a word takes BITS bits."""
        out = np.zeros(columns.shape[1], dtype=np.int64)
        for c in columns:
            out = out << BITS | (c.astype(np.int64) + 1)
        return out

    def numbers(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts (-1: not in the block), a -1 after each; and where each text begins."""
        found, starts = [], [0]
        for t in texts:
            w = words_of(t)
            found.append(np.fromiter(map(self.words.get, w, repeat(-1)), np.int32, len(w)))
            found.append(np.array([-1], dtype=np.int32))
            starts.append(starts[-1] + len(w) + 1)
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.array(starts)

    def probes(self, numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in keys) of the shingles that are among the sorted keys."""
        pos, idx = [], []
        good = numbers >= 0
        for size in self.sizes if len(keys) else []:
            full = good[: max(0, len(good) - size + 1)].copy()
            for k in range(1, size):
                full &= good[k : k + len(full)]
            p = np.flatnonzero(full)
            n = self._numbers(np.stack([numbers[p + k] for k in range(size)]))
            i = np.searchsorted(keys, n)
            hit = keys[np.minimum(i, len(keys) - 1)] == n
            pos.append(p[hit])
            idx.append(i[hit])
        return (np.concatenate(pos), np.concatenate(idx)) if pos else (np.zeros(0, np.int64),) * 2

    def frequencies(self, texts: pd.Series) -> np.ndarray:
        """In how many of the texts each shingle is."""
        numbers, starts = self.numbers(texts)
        pos, idx = self.probes(numbers, self.shingles)
        doc = np.searchsorted(starts, pos, side="right") - 1
        both = np.unique(doc * max(1, len(self.shingles)) + idx)
        return np.bincount(both % max(1, len(self.shingles)), minlength=len(self.shingles))

    def choose(self, frequency: np.ndarray) -> None:
        """Keep of each window its rarest shingle; of equally rare ones the least number, then the first."""
        number, window, offset = self._at
        rank = np.lexsort((offset, number, frequency[np.searchsorted(self.shingles, number)], window))
        first = rank[np.unique(window[rank], return_index=True)[1]]
        order = first[np.argsort(number[first], kind="stable")]
        self.prefix, begins = np.unique(number[order], return_index=True)
        self.begins = np.append(begins, len(order))
        self.at_window, self.at_offset = window[order], offset[order]
        del self._at

    def occurrences(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text begins, and (text, first word, window) of every occurrence of a window."""
        numbers, starts = self.numbers(texts)
        pos, idx = self.probes(numbers, self.prefix)
        many = self.begins[idx + 1] - self.begins[idx]
        pos = np.repeat(pos, many)
        entry = np.repeat(self.begins[idx], many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
        window, begin = self.at_window[entry], pos - self.at_offset[entry]
        doc = np.searchsorted(starts, pos, side="right") - 1
        near = (begin >= starts[doc]) & (begin + self.lengths[window] < starts[doc + 1])
        window, begin, doc = window[near], begin[near], doc[near]
        same = np.ones(len(window), dtype=bool)
        for k in range(self.window.shape[1]):
            inside = same & (k < self.lengths[window])
            same[inside] = numbers[begin[inside] + k] == self.window[window[inside], k]
        return starts, doc[same], (begin - starts[doc])[same], window[same]


HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of intervals, as disjoint ones."""
    if not len(begin):
        return [], []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return begin[new].tolist(), end[last].tolist()


def hit_rows(block: Block, texts: pd.Series) -> pd.DataFrame:
    starts, doc, begin, window = block.occurrences(texts)
    order = np.argsort(doc, kind="stable")
    doc, begin, window = doc[order], begin[order], window[order]
    n_words = np.diff(starts) - 1
    hit: list[tuple] = [([], [], [])] * len(n_words)
    found, first = np.unique(doc, return_index=True)
    for d, a, b in zip(found, first, np.append(first, len(doc))[1:], strict=True):
        w = window[a:b]
        hit[d] = (*merged(begin[a:b], begin[a:b] + block.lengths[w]), sorted({i for k in np.unique(w) for i in block.items[k]}))
    return pd.DataFrame({"n_words": n_words, "starts": [h[0] for h in hit], "ends": [h[1] for h in hit], "items": [h[2] for h in hit]})


def prober(block):
    """The column function that looks a broadcast block's windows up in texts."""

    def probe(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield hit_rows(block.value, texts)

    return F.pandas_udf(probe, HITS)


def _frequencies(documents: DataFrame, text: str, block: Block) -> np.ndarray:
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value.shingles), dtype=np.int64)
        for part in parts:
            total += shared.value.frequencies(part["text"])
        found = np.flatnonzero(total)
        yield pd.DataFrame({"shingle": found, "n": total[found]})

    counted = documents.select(F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(block.shingles), dtype=np.int64)
    out[counted["shingle"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return out


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_rows: int = MAX_ROWS) -> DataFrame:
    """``documents`` with n_words, hits (array of start and end, in words, disjoint and in order) and items (sorted)."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = checkpoint(window_rows(benchmark, item, item_text, window))
    # twice as many words as a block may have on average still have numbers of their own
    n_blocks = max(1, -(-rows.count() // min(max_rows, max(1, (1 << BITS - 1) // window))))

    def block(k: int) -> Block:
        made = Block([(r.item, r.window) for r in (rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == k)).collect()])
        made.choose(_frequencies(documents, text, made))
        return made

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("n_words", "hits", "items")]
    whole = documents.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    spans = lambda starts, ends: F.arrays_zip(starts.alias("start"), ends.alias("end"))
    if n_blocks == 1:
        found = whole.withColumn("found", prober(spark.sparkContext.broadcast(block(0)))(F.col("text")))
        return found.select("row.*", "found.n_words", spans(F.col("found.starts"), F.col("found.ends")).alias("hits"), F.col("found.items").alias("items"))
    # hits depend on the text alone: those of each block are written by the text's hashes and joined once
    hashes = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")}
    folder = scratch(spark, "hits")
    for k in range(n_blocks):
        found = whole.select("text").withColumn("found", prober(spark.sparkContext.broadcast(block(k)))(F.col("text"))).where(F.size("found.starts") > 0)
        found.select(*[c.alias(n) for n, c in hashes.items()], "found.starts", "found.ends", "found.items", F.lit(k).alias("block")).dropDuplicates(["h1", "h2"]).write.parquet(f"{folder}/block={k}")
    every = spark.read.schema("h1 long, h2 long, starts array<int>, ends array<int>, items array<string>").parquet(*[f"{folder}/block={k}" for k in range(n_blocks)])
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    every = every.groupBy("h1", "h2").agg(*lists).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.pandas_udf(_unite, SPANS)("starts", "ends").alias("all"), F.array_sort(F.array_distinct("items")).alias("items"))
    rows = whole.withColumns(hashes)
    joined = rows.join(every, (rows.h1 == every.g1) & (rows.h2 == every.g2), "left")
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return joined.select(
        "row.*",
        F.pandas_udf(_n_words, "long")("text").alias("n_words"),
        spans(some(F.col("all.starts"), "array<int>"), some(F.col("all.ends"), "array<int>")).alias("hits"),
        some(F.col("items"), "array<string>").alias("items"),
    )


SPANS = "starts array<int>, ends array<int>"


def _unite(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    both = [merged(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for a, b in zip(starts, ends, strict=True)]
    return pd.DataFrame({"starts": [x[0] for x in both], "ends": [x[1] for x in both]})


def _n_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(words_of(t))).astype("int64")


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    kept = [F.col(f"`{c}`") for c in documents.columns]
    marked = documents.select(F.struct(*kept).alias("row"), F.col(f"`{options.pop('text', 'text')}`").alias("text"))
    return find(marked, benchmark, **options).where(F.size("hits") == 0).select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, len(list_slice(w, i, i + 9)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)
),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
),
found AS (SELECT r, i, g.n, item_id FROM grams g JOIN windows v ON g.win = v.win AND g.n = v.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
