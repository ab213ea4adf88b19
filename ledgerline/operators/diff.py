"""Comparing two versions: exact texts, sentences as multisets, titles, keyed cells and merged copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T


def exact_pairs(rows: DataFrame, item: str, text: str, key: str, is_new: Column) -> DataFrame:
    """Texts of an item that both versions have exactly once. One aggregate: no self-join, and repeated texts are
    combined on the map side."""
    keyed = rows.select(F.col(item).alias("item"), T.full_text_key(F.col(text)).alias("_t"), F.col(key).alias("_k"), is_new.alias("_new")).where("_t <> ''")
    both = keyed.groupBy("item", F.sha2("_t", 256).alias("text_sha256")).agg(
        F.count_if(~F.col("_new")).alias("n_old"), F.count_if(F.col("_new")).alias("n_new"), F.min(F.when(~F.col("_new"), F.col("_k"))).alias("previous_id"), F.min(F.when(F.col("_new"), F.col("_k"))).alias("current_id")
    )
    return both.where("n_old = 1 and n_new = 1").select("item", "text_sha256", "previous_id", "current_id")


def sentence_rows(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """A row per sentence with its position (from 1) and its key."""
    cut = rows.select(*keep, F.posexplode(T.sentences(F.col(text))).alias("_p", "sentence"))
    return cut.withColumn("position", F.col("_p") + 1).drop("_p").withColumn("sentence_key", T.sentence_key(F.col("sentence")))


def multiset_counts(rows: DataFrame, group: list[str], key: str, is_new: Column) -> DataFrame:
    """Per group and key: how often each version has it."""
    return rows.groupBy(*group, key).agg(F.count_if(~is_new).alias("n_old"), F.count_if(is_new).alias("n_new"))


def diff_totals(rows: DataFrame, group: list[str], key: str, is_new: Column) -> DataFrame:
    """Per group: what both have (duplicates count), and what only one has."""
    counts = multiset_counts(rows, group, key, is_new)
    return counts.groupBy(*group).agg(F.sum(F.least("n_old", "n_new")).alias("shared"), F.sum(F.greatest(F.col("n_old") - F.col("n_new"), F.lit(0))).alias("old_only"), F.sum(F.greatest(F.col("n_new") - F.col("n_old"), F.lit(0))).alias("new_only"))


def surviving(rows: DataFrame, group: list[str], key: str, order: list[str], is_new: Column) -> DataFrame:
    """Occurrences that the other version does not cancel: duplicates cancel one for one, the first ones first."""
    ranked = rows.withColumn("_new", is_new).withColumn("_r", F.row_number().over(Window.partitionBy(*group, key, "_new").orderBy(*order)))
    counts = multiset_counts(rows, group, key, is_new)
    other = F.when(F.col("_new"), F.col("n_old")).otherwise(F.col("n_new"))
    return ranked.join(counts, [*group, key]).where(F.col("_r") > other).drop("_r", "n_old", "n_new")


def full_pairs(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Keys of both versions: matched, or one-sided."""
    a, b = old.withColumn("_a", F.lit(True)), new.withColumn("_b", F.lit(True))
    match = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "matched").when(F.col("_a").isNotNull(), "old_only").otherwise("new_only")
    return a.join(b, on, "full_outer").withColumn("match", match).drop("_a", "_b")


def unique_pairs(old: DataFrame, new: DataFrame, key: str, ident: str) -> DataFrame:
    """Pairs by keys that are unique on both sides."""
    once = lambda df, name: df.groupBy(key).agg(F.count("*").alias("n"), F.min(ident).alias(name)).where("n = 1").drop("n")
    return once(old, "old_id").join(once(new, "new_id"), key)


def cell_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells by key: added, removed, changed or same, and by how much."""
    a, b = old.select(*keys, F.col(value).alias("old_value")), new.select(*keys, F.col(value).alias("new_value"))
    both = full_pairs(a, b, keys)
    kind = F.when(F.col("match") == "old_only", "removed").when(F.col("match") == "new_only", "added").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed")
    return both.select(*keys, "old_value", "new_value", kind.alias("change"), (F.col("new_value") - F.col("old_value")).alias("delta"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def stale(source: DataFrame, derived: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keys whose derived copy is missing or of another version."""
    a, b = source.select(*keys, F.col(version).alias("_v")), derived.select(*keys, F.col(version).alias("_d"))
    return a.join(b, keys, "left").where(~F.col("_v").eqNullSafe(F.col("_d"))).select(*keys)


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent, on, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_digest(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group's set of rows, in whatever order they come; a null is no empty text. Rows become hashes of fixed
    size before they are gathered; the set is the sum of each of their eight words, so that no group is held in one task."""
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]), 256)
    distinct = rows.select(*group, row.alias("_h")).distinct()
    word = lambda k: F.conv(F.substring("_h", 1 + 8 * k, 8), 16, 10).cast("long")
    return distinct.groupBy(*group).agg(F.count("*").alias("rows"), *[F.sum(word(k)).alias(f"digest_{k}") for k in range(8)])
