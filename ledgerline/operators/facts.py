"""Numeric facts over versions and years: which value holds, what conflicts, how it grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import windows


def latest_values(facts: DataFrame, context: list[str], version: str, amount: str) -> DataFrame:
    """Per context, all distinct amounts of its latest version. The version is a combined aggregate, joined back."""
    newest = facts.groupBy(*context).agg(F.max(version).alias("_v"))
    held = facts.join(newest, context).where(F.col(version) == F.col("_v"))
    return held.groupBy(*context, version).agg(F.sort_array(F.collect_set(amount)).alias("amounts"))


def resolved(facts: DataFrame, context: list[str], version: str, amount: str) -> DataFrame:
    """Per context the latest version's amount; ``ambiguous`` where that version disagrees with itself, ``missing`` where it
    tells none."""
    newest = facts.groupBy(*context).agg(F.max(version).alias("_v"))
    held = facts.join(newest, context).where(F.col(version) == F.col("_v"))
    agreed = held.groupBy(*context).agg(F.min(amount).alias("low"), F.max(amount).alias("high"), F.first(version).alias(version))
    status = F.when(F.col("low").isNull(), "missing").when(F.col("low") == F.col("high"), "found").otherwise("ambiguous")
    return agreed.select(*context, version, status.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("amount"))


def status_of(facts: DataFrame, wanted: DataFrame, on: list[str], amount: str) -> DataFrame:
    """For each wanted key: found, missing or ambiguous; no version overrides another."""
    held = facts.groupBy(*on).agg(F.min(amount).alias("low"), F.max(amount).alias("high"))
    state = F.when(F.col("low").isNull(), "missing").when(F.col("low") == F.col("high"), "found").otherwise("ambiguous")
    return wanted.join(held, on, "left").select(*on, state.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("amount"))


def growth(values: DataFrame, key: list[str], year: str, value: str) -> DataFrame:
    """Change from one year to the next: only years that follow each other, only keys with one value in each, not from
    zero; rounded half to even."""
    single = values.groupBy(*key, year).agg(F.count("*").alias("n"), F.min(value).alias("value")).where("n = 1 and value is not null")
    old = single.select(*key, (F.col(year) + 1).alias("to_year"), F.col(year).alias("from_year"), F.col("value").alias("old_value"))
    new = single.select(*key, F.col(year).alias("to_year"), F.col("value").alias("new_value"))
    both = old.join(new, [*key, "to_year"]).where("old_value <> 0")
    pct = F.bround((F.col("new_value") - F.col("old_value")).cast("decimal(20,4)") * 100 / F.abs("old_value").cast("decimal(20,4)"), 2)
    return both.select(*key, "from_year", "to_year", "old_value", "new_value", pct.alias("growth_pct"))


def ratios(values: DataFrame, key: list[str], concept: str, value: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of concepts of the same key; nothing over zero. ``wanted``: name -> (numerator, denominator)."""
    names = sorted({c for pair in wanted.values() for c in pair})
    wide = values.where(F.col(concept).isin(*names)).groupBy(*key).agg(*[F.max(F.when(F.col(concept) == n, F.col(value))).alias(f"_{k}") for k, n in enumerate(names)])
    at = {n: F.col(f"_{k}") for k, n in enumerate(names)}
    pairs = F.array(*[F.struct(F.lit(name).alias("ratio"), F.when(at[b] != 0, F.bround(at[a].cast("decimal(20,4)") / at[b].cast("decimal(20,4)"), 6)).alias("value")) for name, (a, b) in wanted.items()])
    return wide.select(*key, F.explode(pairs).alias("r")).where("r.value is not null").select(*key, "r.ratio", "r.value")


def annual(start: Column, end: Column, low: int = 300, high: int = 380) -> Column:
    """Whether a period is about a year long; one of the three definitions, by its bounds."""
    return F.datediff(end, start).between(low, high)


def fiscal_year_matches(start: Column, end: Column, year_end: Column) -> Column:
    """350 to 380 days, inclusive, that end within two weeks of the fiscal year's end."""
    return (F.abs(F.datediff(end, year_end)) <= 14) & (F.datediff(end, start) + 1).between(350, 380)


def context_variants(facts: DataFrame, context: list[str], value: str) -> DataFrame:
    """Contexts that are told more than once, and whether all tell the same."""
    seen = facts.groupBy(*context).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"))
    return seen.where("n > 1").withColumn("kind", F.when(F.col("n_values") == 1, "same_value").otherwise("multiple_values"))


def footer_totals(cells: DataFrame, table: str, column: str, value: str, is_footer: Column) -> DataFrame:
    """Tables whose last row is the exact sum of the rows above it, in every column."""
    marked = cells.withColumn("_f", is_footer)
    sums = marked.groupBy(table, column).agg(F.sum(F.when(~F.col("_f"), F.col(value))).alias("total"), F.sum(F.when(F.col("_f"), F.col(value))).alias("footer"))
    return sums.groupBy(table).agg(F.every(F.coalesce(F.col("total") == F.col("footer"), F.lit(False))).alias("is_total"), F.count("*").alias("columns"))


def newest_review(rows: DataFrame, reviews: DataFrame, fingerprint: str, when_: str) -> DataFrame:
    """Each row with the newest review of the same fingerprint."""
    newest = windows.first_per_group(reviews, [fingerprint], [F.desc(when_)])
    return rows.join(newest, fingerprint, "left")
