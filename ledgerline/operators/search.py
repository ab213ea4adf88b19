"""Full-text search: queries as trees of words, phrases, and, or, not; texts in weighted fields; rank by cover density.

A query names its words, so a text is ranked by itself: fields are read in order, their words' places go on from field to
field, and every smallest stretch that satisfies the query counts by the weights of its words and how densely it has
them; the sum r becomes r / (r + 1). Only texts that have one of the words, as the JVM's own filter tells, reach Python.
Words are compared in lower case, without stemming.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T

#: Weights of the fields' classes.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
WORD = re.compile(r"[a-z0-9]+")
Query = tuple


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


# ---- queries ---------------------------------------------------------------------------------------------------------


def phrase(text: str) -> Query:
    return ("phrase", tuple(words(text)))


def any_phrase(terms: list[str]) -> Query:
    """Any of the terms; those of several words as phrases."""
    return ("or", tuple(phrase(t) for t in terms if words(t)))


def plain(text: str) -> Query:
    """All words."""
    return ("and", tuple(phrase(w) for w in words(text)))


def expanded(topic: str, thesaurus: dict[str, list[str]]) -> list[str]:
    """The topic's words by what a thesaurus has for them, each once, the whole topic first if it has several."""
    out = [topic.strip()] if " " in topic.strip() else []
    for w in re.findall(r"[a-z0-9&'-]+", topic.lower()):
        out += thesaurus.get(w, [w])
    return list({t.lower(): t for t in reversed(out)}.values())[::-1]


def strict_topic(topic: str, thesaurus: dict[str, list[str]]) -> Query:
    """A topic of several words as its phrase, or all its words, each of which may be one of its single-word synonyms; a
    single word as any of its synonyms."""
    own = words(topic)
    if len(own) < 2:
        return any_phrase(thesaurus.get(own[0], own) if own else [])
    each = [("or", tuple(dict.fromkeys(phrase(o) for o in [w, *[s for s in thesaurus.get(w, []) if " " not in s]]))) for w in own]
    return ("or", (("phrase", tuple(own)), ("and", tuple(each))))


def websearch(text: str) -> Query:
    """As people type: words are all wanted, quoted ones as a phrase, ``or`` between alternatives, a minus before what must
    not be there."""
    alternatives: list[list[Query]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            alternatives.append([])
            continue
        part = phrase(quoted or word)
        if part[1]:
            alternatives[-1].append(("not", (part,)) if minus else part)
    return ("or", tuple(("and", tuple(a)) for a in alternatives if a))


def wanted(query: Query) -> set[str]:
    """The words of a query that a text may have to fit."""
    return set(query[1]) if query[0] == "phrase" else set() if query[0] == "not" else {w for q in query[1] for w in wanted(q)}


def fits(query: Query, places: dict[str, list[int]]) -> bool:
    kind, parts = query
    if kind == "phrase":
        later = [set(places.get(w, ())) for w in parts]
        return bool(parts) and any(all(p + k in later[k] for k in range(1, len(parts))) for p in later[0])
    if kind == "not":
        return not fits(parts[0], places)
    return bool(parts) and (all if kind == "and" else any)(fits(q, places) for q in parts)


# ---- ranking ---------------------------------------------------------------------------------------------------------


def cover_density(query: Query, fields: list[tuple[str | None, float]]) -> float | None:
    """The rank of a text; null where it does not fit."""
    own, entries, at = wanted(query), [], 0
    for text, weight in fields:
        for w in words(text):
            at += 1
            if w in own:
                entries.append((at, w, weight))
    where = lambda part: places_of(part)
    if not fits(query, where(entries)):
        return None
    total, begin = 0.0, 0
    while begin < len(entries):
        end = begin
        while end < len(entries) and not fits(query, where(entries[begin : end + 1])):
            end += 1
        if end == len(entries):
            break
        while begin < end and fits(query, where(entries[begin + 1 : end + 1])):
            begin += 1
        inside = entries[begin : end + 1]
        density = len(inside) / sum(1 / weight for _, _, weight in inside)
        total += density / (1 + inside[-1][0] - inside[0][0] - (len(inside) - 1))
        begin += 1
    return total / (total + 1)


def places_of(entries: list[tuple[int, str, float]]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for at, w, _ in entries:
        out.setdefault(w, []).append(at)
    return out


def ranked(texts: DataFrame, key: str, fields: dict[str, str], query: Query) -> DataFrame:
    """(key, rank) of the texts that fit. ``fields``: column -> class of weight, in reading order."""
    columns = [F.col(c).cast("string") for c in fields]
    weights = [WEIGHTS[w] for w in fields.values()]

    def of(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([cover_density(query, list(zip(row, weights, strict=True))) for row in zip(*part, strict=True)], dtype=float)

    some = "|".join(sorted(map(re.escape, wanted(query)))) or "(?!)"
    may = texts.where(F.lower(F.concat_ws(" ", *columns)).rlike(some))
    out = may.select(key, F.pandas_udf(of, "double")(*columns).alias("rank"))
    return out.where(F.col("rank").isNotNull() & ~F.isnan("rank")).select(key, F.round("rank", 6).alias("rank"))


def hybrid(lists: dict[str, DataFrame], key: str, score: str, k: int) -> DataFrame:
    """Several ranked lists of bounded length, fused by reciprocal ranks, with the methods that found each row."""
    from ledgerline.operators import windows

    whole = None
    for method, rows in lists.items():
        best = rows.orderBy(F.desc_nulls_last(score), key).limit(k).select(F.lit(method).alias("method"), key, F.col(score).alias("score"))
        whole = best if whole is None else whole.unionByName(best)
    fused = windows.fuse_ranks(whole, "method", key, "score")
    methods = whole.groupBy(key).agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return fused.join(methods, key).orderBy(F.desc("fused"), key).limit(k)


def index_scores(queries: DataFrame, texts: DataFrame, key: str, text: str, limit: int = 12) -> DataFrame:
    """The texts of best inverse-frequency score for each query text, of those that share a term: texts' weights are
    (1 + ln n)(1 + ln((1 + N) / (1 + df))) over a length of 1, the query's are not brought to a length."""
    from ledgerline.operators import windows

    own = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*T.STOP_WORDS))
    terms = lambda rows: rows.select(key, F.explode(own).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    held = terms(texts)
    frequency = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(texts.agg(F.count("*").alias("total"))))  # one row
    weight = (1 + F.log("n")) * (1 + F.log((1 + F.col("total")) / (1 + F.col("df"))))
    raw = held.join(frequency, "term").select(key, "term", weight.alias("w"))
    gathered = raw.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = gathered.select(F.col(key).alias("d"), "norm", F.explode("t").alias("e")).select("d", F.col("e.term").alias("term"), (F.col("e.w") / F.col("norm")).alias("w_d"))
    asked = terms(queries).join(frequency, "term").select(F.col(key).alias("q"), "term", weight.alias("w_q"))
    scores = asked.join(vectors, "term").groupBy("q", "d").agg(F.round(F.sum(F.col("w_q") * F.col("w_d")), 9).alias("score"))
    return windows.top_per_group(scores, ["q"], [F.desc("score"), F.asc("d")], limit)


def index_score(query: str, text: str, frequency: dict[str, int], total: int) -> float:
    """The same for one pair, by the definition."""
    count = lambda t: Counter(w for w in re.findall(r"\w+", t.lower()) if len(w) > 1 and w not in T.STOP_WORDS)
    weigh = lambda c: {w: (1 + math.log(n)) * (1 + math.log((1 + total) / (1 + frequency[w]))) for w, n in c.items() if w in frequency}
    a, b = weigh(count(query)), weigh(count(text))
    norm = math.sqrt(sum(x * x for x in b.values())) or 1
    return sum(x * b.get(w, 0) / norm for w, x in a.items())


def like_patterns(phrase_: str, stop: frozenset[str] = frozenset(T.STOP_WORDS)) -> list[str]:
    """The patterns by which a phrase finds names: the whole of it, then its words, plurals as singulars."""
    own = [w for w in words(phrase_) if w not in stop]
    single = [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in own]
    return list(dict.fromkeys([f"%{'%'.join(own)}%", *[f"%{w}%" for w in single]])) if own else []


def highlighted(old: Column, new: Column) -> Column:
    """How two texts differ word by word, white space, case and signs aside: words that went, words that came, and whether
    they are the same."""

    def key(w: str) -> str:
        return re.sub(r"[^\w%$]+", "", w.lower())

    def one(a: str | None, b: str | None) -> tuple[list[str], list[str], bool]:
        from difflib import SequenceMatcher

        x, y = ([w for w in (t or "").split() if key(w)] for t in (a, b))
        went, came = [], []
        for what, i, j, k, m in SequenceMatcher(None, [key(w) for w in x], [key(w) for w in y], autojunk=False).get_opcodes():
            if what != "equal":
                went += x[i:j]
                came += y[k:m]
        return went, came, not went and not came

    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in parts:
            yield pd.DataFrame([one(p, q) for p, q in zip(a, b, strict=True)], columns=["removed", "added", "identical"])

    return F.pandas_udf(of, "removed array<string>, added array<string>, identical boolean")(old, new)
