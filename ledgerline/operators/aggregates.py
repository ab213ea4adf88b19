"""Counts, shares and profiles over the table of changes. All are one shuffle on the group key, combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["company", "previous_year", "current_year"]
TYPES = ("Unchanged", "Modified", "Reworded", "Expanded", "Reduced", "New", "Removed")
NOT_ANALYSED = "Not analysed"


def exact_avg(column: str, digits: int) -> Column:
    """An average of an exact sum that rounds once, last, halves up."""
    power = float(10**digits)
    return F.floor(F.sum(F.col(column).cast("decimal(28,10)")).cast("double") * power / F.count(column) + 0.5).cast("double") / power


def count_by(changes: DataFrame, *keys: str | Column) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count("*").alias("n"))


def distribution(changes: DataFrame, dims: list[str], positive: Column, score: str) -> DataFrame:
    """Per group: n, its share within the outer dimensions, how many are positive, and the average score."""
    groups = changes.groupBy(*[F.coalesce(F.col(d), F.lit(NOT_ANALYSED)).alias(d) for d in dims]).agg(F.count("*").alias("n"), F.count_if(positive).alias("positive"), exact_avg(score, 3).alias("avg_score"))
    outer = Window.partitionBy(*dims[:-1]) if dims[:-1] else Window.partitionBy(F.lit(1))
    return groups.withColumn("pct", F.round(F.col("n") * F.lit(100).cast("decimal(28,10)") / F.sum("n").over(outer), 1).cast("double"))


def profile(changes: DataFrame) -> DataFrame:
    """One row per run with a column for each kind of change."""
    counts = [F.count_if(F.col("change_type") == t).alias(t.lower()) for t in TYPES]
    changed = F.count_if(F.col("change_type").isNotNull() & (F.col("change_type") != "Unchanged"))
    share = F.round(changed * F.lit(100).cast("decimal(28,10)") / F.nullif(F.count("change_type"), F.lit(0)), 1).cast("double")
    return changes.groupBy(*RUN).agg(F.count("*").alias("alignments"), *counts, F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if(F.col("material") == "Yes").alias("material_yes"), share.alias("pct_changed"), exact_avg("materiality_score", 3).alias("avg_materiality"))


def changes_by_item(changes: DataFrame) -> DataFrame:
    return changes.groupBy("item").agg(F.count_if(F.col("change_type") != "Unchanged").alias("changed"), F.count_if(F.col("material") == "Yes").alias("material_yes"), F.count("*").alias("total"))


def confidence_histogram(changes: DataFrame) -> DataFrame:
    return changes.where("confidence_score is not null").groupBy("confidence_score").agg(F.count("*").alias("n"), F.count_if(F.col("material") == "Yes").alias("material_yes"))


def disagreement_matrix(changes: DataFrame) -> DataFrame:
    both = changes.where("semantic_label is not null and lexical_label is not null and semantic_label <> lexical_label")
    return both.groupBy("semantic_label", "lexical_label", F.col("change_type").alias("final_label")).agg(F.count("*").alias("n"))


def agreement(changes: DataFrame) -> DataFrame:
    both = changes.where("semantic_label is not null and lexical_label is not null")
    same = F.col("semantic_label") == F.col("lexical_label")
    return both.agg(F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"), F.count("*").alias("compared"))


def overview(runs: DataFrame, changes: DataFrame, on: list[str]) -> DataFrame:
    """Every run, those without changes too."""
    counted = changes.groupBy(*on).agg(F.count("*").alias("n"), F.count("material").alias("analysed"))
    return runs.join(counted, on, "left").na.fill(0, ["n", "analysed"])


def kpis(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("total"), F.count_if(F.col("change_type") != "Unchanged").alias("changed"), F.count_if(F.col("material") == "Yes").alias("material"), F.count_if(F.col("status") == "needs_review").alias("review"))


def ordered_texts(members: DataFrame, group: str, order: str, text: str, wanted: Column) -> DataFrame:
    """Texts of each group in order, as one text and as an array; groups without wanted ones have an empty array."""
    pair = F.when(wanted, F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    held = F.array_sort(F.collect_list(pair))
    listed = members.groupBy(group).agg(held.alias("_held"))
    texts = F.transform("_held", lambda x: x["t"])
    return listed.select(group, F.array_join(texts, " | ").alias("joined"), F.size("_held").alias("n"))


def grouped_sets(rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Totals on every level of a hierarchy, as a report shows them."""
    return rows.rollup(*left).agg(*[F.sum(c).alias(c) for c in right], F.grouping_id().alias("level"))
