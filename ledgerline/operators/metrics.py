"""Tagged metrics over filings: what a concept's values are once versions, repeats and conflicts are settled.

``values`` frames have one row per tagged value. Nulls are values of their own in every context key, so that a fact without
a member and one with are different contexts. Empty frames give empty frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls of the key are equal; the right side brings its other columns only."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in on])


def latest_context_values(values: DataFrame, context: list[str], year: str, amount: str) -> DataFrame:
    """The values whose amount the latest filing year of their context has too, with that year and in how many amounts it
    tells the context (``latest_amounts``): older values that disagree go, equal repeats stay."""
    newest = values.groupBy(*context).agg(F.max(year).alias("latest_year"))
    held = joined(values, newest, context)
    latest = held.where(F.col(year) == F.col("latest_year")).groupBy(*context).agg(F.collect_set(F.coalesce(F.col(amount).cast("string"), F.lit("nil"))).alias("_latest"))
    told = joined(held, latest, context).withColumn("latest_amounts", F.size("_latest"))
    return told.where(F.array_contains("_latest", F.coalesce(F.col(amount).cast("string"), F.lit("nil")))).drop("_latest")


def merge_by_concept(values: DataFrame, entity: list[str], context: list[str], year: str, amount: str, member: str, label: str, lists: list[str]) -> DataFrame:
    """One row per entity: its metadata of the latest filing, the union of its list columns over all filings, how many
    values the latest-context rule keeps, and whether any of these is company-wide (has no ``member``)."""
    meta = values.groupBy(*entity).agg(
        F.max(year).alias("metadata_year"),
        F.max_by(label, F.struct(year, label)).alias("label"),
        F.array_sort(F.collect_set(year)).alias("years"),
        *[F.array_sort(F.collect_set(c)).alias(f"all_{c}") for c in lists],
    )
    kept = latest_context_values(values, [*entity, *context], year, amount)
    counts = kept.groupBy(*entity).agg(F.count("*").alias("n_values"), F.when(F.count_if(F.col(member).isNull()) > 0, "company_wide").otherwise("dimension_only").alias("scope"))
    return meta.join(counts, entity)


def scope_counts(metrics: DataFrame, by: list[str]) -> DataFrame:
    """How many merged metrics there are, of which scope, and how many values."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("verified_concepts"),
        F.count_if(F.col("scope") == "company_wide").alias("company_wide"),
        F.count_if(F.col("scope") == "dimension_only").alias("dimension_only"),
        F.sum("n_values").alias("value_records"),
    )


def merged_values(values: DataFrame, full_context: list[str], lists: list[str], source: str) -> DataFrame:
    """Values that agree in full context and accuracy as one, with the union of their items and labels."""
    return values.groupBy(*full_context).agg(F.count("*").alias("n_sources"), F.min(source).alias("first_source"), *[F.array_sort(F.collect_set(c)).alias(c) for c in lists])


def kept_conflicts(values: DataFrame, context: list[str], amount: str, ordinal: str) -> DataFrame:
    """Repeats of one amount in a context as their first; different amounts all stay, marked as a conflict."""
    once = values.groupBy(*context, amount).agg(F.min(ordinal).alias("first"), F.count("*").alias("repeats"))
    told = once.groupBy(*context).agg((F.count("*") > 1).alias("conflict"))
    return joined(once, told, context)


def value_order(end: Column, start: Column, dimensions: Column, unit: Column, *rest: Column) -> list[Column]:
    """The deterministic order of a metric's values: period end, start, hash of dimensions, unit, hash of the record."""
    digest = lambda c: F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)
    return [F.coalesce(end, F.lit("")), F.coalesce(start, F.lit("")), digest(dimensions), unit, digest(F.to_json(F.struct(end, start, dimensions, unit, *rest)))]


def merged_candidates(candidates: DataFrame, concept: str, score: str, taxonomy: str, available: str, most: int = 12) -> DataFrame:
    """Candidates of several taxonomies by concept: best score, the taxonomies, whether any has facts; the first ``most``."""
    out = candidates.groupBy(concept).agg(F.max(score).alias(score), F.array_sort(F.collect_set(taxonomy)).alias("taxonomies"), F.bool_or(available).alias(available))
    return out.orderBy(F.desc(score), concept).limit(most)


#: Scores from which a name match selects a concept by itself.
STRONG = 90


def selected_concept(candidates: DataFrame, concept: str, score: str) -> DataFrame:
    """One row: the concept of the only best strong candidate, or why there is none."""
    best = candidates.agg(F.max(score).alias("best"), F.count("*").alias("n")).join(
        candidates.groupBy(score).agg(F.count("*").alias("ties"), F.min(concept).alias("concept")), F.col("best") == F.col(score), "left"
    )
    status = F.when(F.col("n") == 0, "metric_not_found").when(F.col("best") < STRONG, "needs_concept_selection").when(F.col("ties") > 1, "ambiguous_metric").otherwise("selected")
    return best.select(status.alias("status"), F.when(status == "selected", F.col("concept")).alias("concept"))


def by_year(facts: DataFrame, selected: DataFrame, years: list[int], concept: str, year: str, amount: str) -> DataFrame:
    """For each wanted year the selected concept's status (found, missing, ambiguous) and amount."""
    spark = facts.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(y,) for y in sorted(set(years))], f"{year} int"))  # a list in the question
    told = facts.join(F.broadcast(selected.where("status = 'selected'").select(F.col("concept").alias(concept))), concept)
    held = told.groupBy(year).agg(F.min(amount).alias("low"), F.max(amount).alias("high"), F.count("*").alias("records"))
    state = F.when(F.col("low").isNull(), "missing").when(F.col("low") == F.col("high"), "found").otherwise("ambiguous")
    return wanted.join(held, year, "left").select(year, state.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("amount"), F.coalesce("records", F.lit(0)).alias("records"))


def represented(facts: DataFrame, concept: str, member: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Entity-wide facts under their own concept, and facts that a rule documents as another concept's component: ``rules``
    maps a concept to the (concept, member) that represents it."""
    own = facts.where(F.col(member).isNull()).withColumn("basis", F.lit("official_concept"))
    parts = [facts.where((F.col(concept) == c) & (F.col(member) == m)).withColumns({concept: F.lit(name), "basis": F.lit("component_rule")}) for name, (c, m) in sorted(rules.items())]
    return reduce(DataFrame.unionByName, parts, own)


def signature_matches(records: DataFrame, occurrences: DataFrame, signature: list[str], accuracy: str, key: str) -> DataFrame:
    """Records with how many tagged occurrences have their exact signature; an accuracy that a record lacks fits any."""
    told = occurrences.groupBy(*signature, accuracy).agg(F.count("*").alias("n")).withColumnRenamed(accuracy, "_accuracy")
    fits = joined(records.select(key, *signature, accuracy), told, signature).where(F.col(accuracy).isNull() | (F.col(accuracy) == F.col("_accuracy")))
    found = fits.groupBy(key).agg(F.sum("n").alias("occurrences"))
    status = F.when(F.col("occurrences").isNull(), "unmatched").when(F.col("occurrences") == 1, "unique").otherwise("repeated")
    return records.select(key).join(found, key, "left").select(key, F.coalesce("occurrences", F.lit(0)).alias("occurrences"), status.alias("status"))


def version_diagnostics(values: DataFrame, context: list[str], version: str, amount: str, by: list[str]) -> DataFrame:
    """Of each group: contexts, those settled by the latest version, and those left out because it disagrees with itself."""
    newest = values.groupBy(*context).agg(F.max(version).alias("_v"), F.count_distinct(version).alias("_n"))
    told = joined(values, newest, context).where(F.col(version) == F.col("_v")).groupBy(*context).agg(F.count_distinct(amount).alias("amounts"), F.max("_n").alias("versions"))
    return told.groupBy(*by).agg(
        F.count("*").alias("contexts"),
        F.count_if((F.col("amounts") <= 1) & (F.col("versions") > 1)).alias("superseded"),
        F.count_if(F.col("amounts") > 1).alias("omitted_as_ambiguous"),
    )


def stored_levels(documents: DataFrame, document: str, metrics: str, values: str, sources: str) -> dict[str, DataFrame]:
    """A nested export as its four tables: documents, metrics, values, sources, with the positions that rebuild it."""
    m = documents.select(document, F.posexplode(metrics).alias("metric_no", "m"))
    v = m.select(document, "metric_no", F.posexplode(f"m.{values}").alias("value_no", "v"))
    s = v.select(document, "metric_no", "value_no", F.posexplode(f"v.{sources}").alias("source_no", "s"))
    flat = lambda df, c, nested: df.select(*[x for x in df.columns if x != c], f"{c}.*").drop(nested)
    return {"documents": documents.drop(metrics), "metrics": flat(m, "m", values), "values": flat(v, "v", sources), "sources": flat(s, "s", "")}
