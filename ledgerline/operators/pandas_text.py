"""Text operators that need a sequential walk: difflib ratios, greedy pairs, packing. Arrow batches, bounded groups."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\b\w+(?:['’]\w+)*\b")
METRICS = "sequence_ratio double, length_ratio double, word_delta int, added array<string>, removed array<string>"


def word_list(text: str | None) -> list[str]:
    return [w.casefold() for w in WORD.findall(text or "")]


def compared(old: str | None, new: str | None, sample: int = 20) -> tuple:
    """Word-wise ratio, length ratio, difference and samples of what came and went."""
    a, b = word_list(old), word_list(new)
    if not a or not b:
        same = not a and not b
        return (1.0 if same else 0.0), (1.0 if same else 0.0), len(b) - len(a), b[:sample], a[:sample]
    match = difflib.SequenceMatcher(None, a, b, autojunk=False)
    came, went = [], []
    for what, i, j, k, m in match.get_opcodes():
        if what != "equal":
            went += a[i:j]
            came += b[k:m]
    return round(match.ratio(), 6), round(len(b) / len(a), 6), len(b) - len(a), came[:sample], went[:sample]


def text_metrics(old: Column, new: Column) -> Column:
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in parts:
            yield pd.DataFrame([compared(x, y) for x, y in zip(a, b, strict=True)], columns=["sequence_ratio", "length_ratio", "word_delta", "added", "removed"])

    return F.pandas_udf(of, METRICS)(old, new)


def greedy_pairs(scores: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of each group, best scores first. The group is a document's pair, of bounded size."""
    schema = ", ".join([*[f"{g} string" for g in group], "left_id long, right_id long, score double"])

    def take(part: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, out = set(), set(), []
        for r in part.sort_values([score, left, right], ascending=[False, True, True]).itertuples(index=False):
            a, b = getattr(r, left), getattr(r, right)
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                out.append((*[getattr(r, g) for g in group], a, b, getattr(r, score)))
        return pd.DataFrame(out, columns=[*group, "left_id", "right_id", "score"])

    return scores.groupBy(*group).applyInPandas(take, schema)


def packed(text: Column, most: int, least: int) -> Column:
    """Chunks of paragraphs: short ones join the one before, long ones are cut between sentences."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t or "", most, least))

    return F.pandas_udf(of, "array<string>")(text)


def chunks(text: str, most: int, least: int) -> list[str]:
    """Paragraphs, which blank lines part, their lines joined. One that follows less than ``least`` characters joins them
    under a blank line; what is then longer than ``most`` is cut between sentences, and within one between words."""
    plain = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    joined: list[str] = []
    for paragraph in filter(None, plain):
        if joined and len(joined[-1]) < least:
            joined[-1] += "\n\n" + paragraph
        else:
            joined.append(paragraph)
    return [part for whole in joined for part in ([whole] if len(whole) <= most else fitted(whole, most))]


def fitted(paragraph: str, most: int) -> list[str]:
    """Sentences packed while they fit; a sentence that is too long by itself gives its words, packed."""
    units: list[list[str]] = [[]]
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", paragraph):
        if units[-1] and sum(map(len, units[-1])) + len(units[-1]) + len(sentence) > most:
            units.append([])
        units[-1].append(sentence)
    packed_: list[str] = []
    for unit in units:
        line = " ".join(unit)
        if len(line) <= most:
            packed_.append(line)
        else:
            packed_ += words_packed(line.split(), most)
    return packed_


def words_packed(words: list[str], most: int) -> list[str]:
    out, held = [], 0
    for k in range(1, len(words) + 1):
        if k == len(words) or len(" ".join(words[held : k + 1])) > most:
            out.append(" ".join(words[held:k]))
            held = k
    return out


def batches(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Numbers of consecutive batches whose sizes add up to at most ``most``; a larger row is a batch of its own."""
    schema = rows.select(group, order, size).withColumn("batch", F.lit(0)).schema

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        n, total, out = 0, 0, []
        for s in part[size]:
            if total and total + s > most:
                n, total = n + 1, 0
            total += s
            out.append(n)
        return part.assign(batch=pd.Series(out, index=part.index, dtype="int32"))

    return rows.select(group, order, size).groupBy(group).applyInPandas(pack, schema)
