"""Passages in their order: neighbours, sections, assembled excerpts, checked proposals, evidence within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """The value before and after each row, by position, not by what happens to be next to it."""
    w = Window.partitionBy(group).orderBy(position)
    near = lambda f, step: F.when(f(position).over(w) == F.col(position) + step, f(value).over(w))
    return rows.withColumn("before", near(F.lag, -1)).withColumn("after", near(F.lead, 1))


def sections(events: DataFrame, group: str, position: str, is_start: Column, is_end: Column, size: Column) -> DataFrame:
    """From each start to the next end after it, with the size of what lies between; the largest of a group wins, the
    earliest of equally large ones."""
    w = Window.partitionBy(group).orderBy(position)
    marked = events.withColumn("_end", F.min(F.when(is_end, F.col(position))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    marked = marked.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = marked.select(F.col(group).alias("_g"), F.col(position).alias("_end"), (F.col("_sum") - size).alias("_upto"))
    whole = marked.where(is_start & F.col("_end").isNotNull()).join(ends.withColumnRenamed("_g", group), [group, "_end"])
    held = whole.withColumn("held", F.col("_upto") - F.col("_sum"))
    best = held.groupBy(group).agg(F.max(F.struct("held", (-F.col(position)).alias("p"), (-F.col("_end")).alias("e"))).alias("b")).where("b.held > 0")
    return best.select(group, (-F.col("b.p")).alias("start"), (-F.col("b.e")).alias("end"), F.col("b.held").alias("held"))


def assembled(sentences: DataFrame, group: str, position: str, text: str, gap: str = " [...] ") -> DataFrame:
    """A text per group of selected sentences, with a mark where some were left out. A group is one excerpt."""
    w = Window.partitionBy(group).orderBy(position)
    lead = F.when(F.lag(position).over(w).isNull(), "").when(F.col(position) - F.lag(position).over(w) > 1, gap).otherwise(" ")
    cut = sentences.withColumn("_t", F.concat(lead, F.col(text)))
    joined = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("_t").alias("t"))))
    return cut.groupBy(group).agg(joined.alias("_j")).select(group, F.array_join(F.transform("_j", lambda x: x["t"]), "").alias("excerpt"), F.size("_j").alias("n"))


def checked_proposals(proposals: DataFrame, allowed: DataFrame, proposal: str, member: str) -> DataFrame:
    """Each proposal: accepted, or why not. A member that is unknown spoils its proposal, one that is used twice spoils
    every user."""
    known = allowed.select(member).distinct().withColumn("_known", F.lit(True))
    used = proposals.groupBy(member).agg(F.count("*").alias("_uses"))
    told = proposals.join(used, member).join(known, member, "left")
    return told.groupBy(proposal).agg(F.max(F.col("_known").isNull()).alias("unknown"), F.max(F.col("_uses") > 1).alias("shared")).withColumn("status", F.when(F.col("unknown"), "unknown_member").when(F.col("shared"), "member_used_twice").otherwise("accepted")).select(proposal, "status")


def unassigned(allowed: DataFrame, proposals: DataFrame, member: str) -> DataFrame:
    return allowed.join(proposals, member, "left_anti")


def evidence(rows: DataFrame, group: str, position: str, score: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """The best rows of each group, in their own order, as long as their sizes fit a budget."""
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(position)))).where(F.col("_r") <= most_rows)
    running = F.sum(size).over(Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return best.withColumn("_upto", running).where(F.col("_upto") <= most_size).drop("_r", "_upto")


def unordered_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs, whichever side names which."""
    return rows.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count("*").alias("n"))


def newest_within(rows: DataFrame, runs: DataFrame, key: str, low: str, high: str, at: str, version: str) -> DataFrame:
    """For each row the newest version of the runs of its key whose range holds it. The places are looked up once each: rows
    that are the same, or lie at the same place, each keep their row."""
    places = rows.select(key, at).distinct()
    inside = places.join(runs.select(F.col(key).alias("_key"), low, high, version), (F.col(key) == F.col("_key")) & F.col(at).between(F.col(low), F.col(high)))
    newest = inside.groupBy(F.col(key).alias("_k"), F.col(at).alias("_at")).agg(F.max(version).alias("newest"))
    return rows.join(newest, rows[key].eqNullSafe(F.col("_k")) & rows[at].eqNullSafe(F.col("_at")), "left").drop("_k", "_at")


def ranked_matches(names: DataFrame, name: str, query: str, limit: int) -> DataFrame:
    """Names by how well they match a query: equal, without signs equal, a beginning, or by shared words."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    want = F.lit(" ".join(query.lower().split()))
    words = F.array_distinct(F.split(F.trim(plain(F.col(name))), " "))
    asked = F.array_distinct(F.split(want, " "))
    shared = F.size(F.array_intersect(words, asked))
    score = F.when(F.col(name) == F.lit(query), 100.0).when(F.trim(plain(F.col(name))) == want, 95.0).when(F.trim(plain(F.col(name))).startswith(want), 92.0).when(shared == F.size(asked), 55 + 25.0 * shared / F.size(words)).when(shared > 0, 35.0 * shared / F.size(asked))
    return names.withColumn("score", F.round(score, 6)).where("score is not null").orderBy(F.desc("score"), F.asc(name)).limit(limit)


def first_of_shared(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of blocks that several items share, the one that comes first. The earliest is a combined aggregate, so that a
    block shared by very many rows is not sorted in one task."""
    first = blocks.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return blocks.join(first, keys).where(F.struct(*order) == F.col("_first")).drop("_first")


def unpivot_texts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per non-empty text field with its content hash, by which embeddings are reused."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    long = rows.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.text")
    return long.where("text is not null and text <> ''").select(key, "field", F.sha2("text", 256).alias("text_sha256"))
