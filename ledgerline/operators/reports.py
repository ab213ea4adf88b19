"""Nested reports as rows and rows as reports: members, findings, evidence, coverage, scopes, review rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.metrics import joined

# ---- reports to rows -------------------------------------------------------------------------------------------------


def flat_members(reports: DataFrame, row: str, sides: dict[str, str], member: str = "id") -> DataFrame:
    """A row's members on each side (side name -> array of ids) with their positions."""

    def of(name: str, c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<long>")), lambda x, k: F.struct(F.lit(name).alias("side"), k.alias("position"), x.alias(member)))

    pairs = F.flatten(F.array(*[of(name, c) for name, c in sides.items()]))
    return reports.select(row, F.explode(pairs).alias("m")).select(row, "m.*")


def two_level_text(reports: DataFrame, key: str, outer: str, inner: str, text: str, sep: str = " ") -> DataFrame:
    """The texts of a list of lists, in both orders, as one text; reports without any keep a null."""
    inside = reports.select(key, F.posexplode_outer(outer).alias("i", "o")).select(key, "i", F.posexplode_outer(f"o.{inner}").alias("j", "x"))
    held = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col(f"x.{text}").isNotNull(), F.struct("i", "j", F.col(f"x.{text}").alias("t"))))).alias("a"))
    return held.select(key, F.nullif(F.array_join(F.transform("a", lambda e: e["t"]), sep), F.lit("")).alias("text"))


def evidence_rows(findings: DataFrame, key: str, ids: str, catalog: DataFrame, catalog_id: str) -> DataFrame:
    """A finding's evidence in its order, with what the catalog says of each id, if anything."""
    told = findings.select(key, F.posexplode_outer(ids).alias("place", "_id"))
    return told.join(catalog.withColumnRenamed(catalog_id, "_id"), "_id", "left").withColumnRenamed("_id", catalog_id)


def in_rank_order(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of a ranked list of ids, in its order: ``hits`` has the key, rank and score."""
    return hits.join(rows, key).orderBy("rank")


def bridged_scores(scores: DataFrame, bridge: DataFrame, member: str, row: str, score: str) -> DataFrame:
    """Scores of members as the best score of each row that has them."""
    return scores.join(bridge.select(member, row), member).groupBy(row).agg(F.max(score).alias(score), F.count("*").alias("scored_members"))


def staleness(reports: DataFrame, loads: DataFrame, key: str, low: str, high: str, year: str, built: str, loaded: str) -> DataFrame:
    """Whether anything was loaded, for a year that a report covers, after it was built. Loads are few per key and year:
    they are reduced to their newest first."""
    newest = loads.groupBy(key, year).agg(F.max(loaded).alias("_at"))
    seen = reports.join(newest, key, "left").groupBy(*reports.columns).agg(F.max(F.when(F.col(year).between(F.col(low), F.col(high)), F.col("_at"))).alias("newest_load"))
    return seen.withColumn("stale", F.coalesce(F.col("newest_load") > F.col(built), F.lit(False)))


# ---- sections and windows --------------------------------------------------------------------------------------------


def equivalent_sections(groups: DataFrame, position: str, manual: Column, old_key: Column, new_key: Column, has_old: Column, has_new: Column) -> DataFrame:
    """Groups with the key under which they count as one section: pairs that were made by hand, or that join different
    topics, stay by themselves; the others go by their title."""
    alone = manual | (has_old & has_new & (old_key != new_key))
    key = F.when(alone, F.concat(F.lit("existing_pair:"), F.col(position).cast("string"))).otherwise(F.concat(F.lit("equivalent_title:"), F.when(has_old, old_key).otherwise(new_key)))
    return groups.withColumn("section_key", key)


def without_unchanged(entries: DataFrame, section: list[str], key: str, new: str, order: str) -> DataFrame:
    """Entries but those that the other side has as well, each once for each: of equal ones the first go. The sides'
    counts are combined before the rows are numbered."""
    counts = entries.groupBy(*section, key).agg(F.count_if(~F.col(new)).alias("_old"), F.count_if(F.col(new)).alias("_new"))
    w = Window.partitionBy(*section, key, new).orderBy(order)
    numbered = joined(entries.withColumn("_k", F.row_number().over(w)), counts, [*section, key])
    return numbered.where(F.col("_k") > F.least("_old", "_new")).drop("_k", "_old", "_new")


def adjacent_windows(targets: DataFrame, results: DataFrame, on: list[str], year: str, what: str) -> DataFrame:
    """Each target with the results of the windows that end or begin with its year, as a sorted array."""
    ends = results.select(*on, F.col("current_year").alias(year), F.lit("into").alias("window"), what)
    begins = results.select(*on, F.col("previous_year").alias(year), F.lit("out_of").alias("window"), what)
    told = ends.union(begins).groupBy(*on, year).agg(F.array_sort(F.collect_list(F.struct("window", what))).alias("adjacent"))
    return targets.join(told, [*on, year], "left")


def consecutive_scopes(years: DataFrame, company: str, year: str) -> DataFrame:
    """The pairs of a company's years that follow each other in order, whatever lies between."""
    w = Window.partitionBy(company).orderBy(year)
    return years.select(company, year).distinct().select(company, F.col(year).alias("previous"), F.lead(year).over(w).alias("current")).where("current is not null")


def affected_pairs(pairs: DataFrame, year: int) -> DataFrame:
    """The year pairs that a change of one year touches."""
    return pairs.where((F.col("previous") == year) | (F.col("current") == year))


# ---- counts ----------------------------------------------------------------------------------------------------------


def overviews(runs: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Runs with the number of rows that each part has of them, zero included."""
    for name, part in parts.items():
        runs = runs.join(part.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return runs


def first_passing(rows: DataFrame, by: list[str], value: str, passes: Column) -> DataFrame:
    """The least value that passes, or the least of all where none does, and how many are known not to pass."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.min(F.when(passes, F.col(value))), F.min(value)).alias("first"),
        F.count_if(F.coalesce(~passes, F.lit(False))).alias("failing"),
    )


def summary_counts(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """For each column its values' counts, as one long table."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return rows.select(*by, each.alias("c")).groupBy(*by, "c.what", "c.value").agg(F.count("*").alias("n"))


def grouping_summary(rows: DataFrame, by: list[str], before: str, after: str, status: str) -> DataFrame:
    """Rows by how many members they join, and how many of them are settled."""
    kind = F.when((F.size(before) == 0) | (F.size(after) == 0), "one_sided").when((F.size(before) == 1) & (F.size(after) == 1), "one_to_one").when(F.size(before) == 1, "split").when(F.size(after) == 1, "merge").otherwise("many_to_many")
    return rows.groupBy(*by, kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.size(before) + F.size(after)).alias("members"), F.count_if(F.col(status) != "needs_review").alias("settled"))


def coverage(cells: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Cells that are not used exactly once, and uses of cells that are not there."""
    times = used.groupBy(*key).agg(F.count("*").alias("times"))
    both = joined(cells.select(*key).distinct().withColumn("_there", F.lit(True)), times, key, "left").select(*key, F.coalesce("times", F.lit(0)).alias("times"), F.lit("cell").alias("of"))
    lost = times.join(cells.select(*key).distinct(), key, "left_anti").select(*key, "times", F.lit("nothing").alias("of"))
    return both.where("times <> 1").unionByName(lost)


def citation_share(rows: DataFrame, by: list[str], cited: str, known: str) -> DataFrame:
    """The percentage of known ids that are cited, rounded half to even; null where none is known."""
    held = rows.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list(cited))).alias("c"), F.array_distinct(F.flatten(F.collect_list(known))).alias("k"))
    share = F.when(F.size("k") > 0, F.bround(100.0 * F.size(F.array_intersect("c", "k")) / F.size("k"), 1))
    return held.select(*by, F.size("k").alias("known"), share.alias("cited_pct"))


def usage_totals(calls: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """Tokens by item and stage; calls without a count are unknown, not zero, and so is a total of only such calls."""
    return calls.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("calls"), F.count_if(F.col(tokens).isNull()).alias("unknown"))


# ---- rows that a rule selects ----------------------------------------------------------------------------------------

#: Reasons that block a match, statuses of accepted ones, and labels of changes.
BLOCKED = ("agent_did_not_finish", "invalid_or_omitted_verifier_proposal", "absence_not_proven_by_retrieval")
ACCEPTED = ("ai_verified", "auto_matched", "unmatched")
CHANGE_LABELS = ("Added", "Removed", "Modified", "Expanded", "Reduced", "Relocated", "Reworded", "Unchanged")


def unreviewable(status: Column, before: Column, after: Column) -> Column:
    """A row to be reviewed that has members on one side only."""
    return (status == "needs_review") & ((F.size(before) == 0) | (F.size(after) == 0))


def material_targets(targets: DataFrame, results: str, flag: str) -> DataFrame:
    """Targets any of whose nested results is material."""
    return targets.where(F.exists(results, lambda r: F.coalesce(r[flag] == "Yes", F.lit(False))))


def verification_plan(rows: DataFrame, ledger: DataFrame, key: list[str], confidence: str, threshold: float) -> DataFrame:
    """Rows of low or no confidence whose present form (key and hash) has not been verified yet."""
    low = rows.where(F.col(confidence).isNull() | (F.col(confidence) < threshold))
    return low.join(ledger.select(*key).distinct(), key, "left_anti")


def supported(before: Column, after: Column, reasons: Column, status: Column, explained: Column, cited: Column) -> Column:
    """Whether a match stands: both sides, no blocking reason, nothing unexplained, and evidence for just its members."""
    members = F.concat(before, after)
    settled = status.isin("auto_matched", "ai_verified") | ((status == "needs_review") & (F.size(reasons) > 0))
    own = (F.size(F.array_distinct(members)) == F.size(members)) & (F.array_sort(F.array_distinct(cited)) == F.array_sort(members))
    return (F.size(before) > 0) & (F.size(after) > 0) & ~F.arrays_overlap(reasons, F.array(*[F.lit(b) for b in BLOCKED])) & settled & (F.trim(explained) != "") & own


def needs_change_review(source_file: Column, change_status: Column) -> Column:
    return F.coalesce(source_file == "needs_review.json", F.lit(False)) | F.coalesce(change_status == "needs_review", F.lit(False))


def ai_approved_change(source_file: Column, status: Column, change_status: Column, label: Column) -> Column:
    """A change that a model settled and nobody needs to look at."""
    done = status.isin(*ACCEPTED) & (change_status == "completed") & label.isin(*CHANGE_LABELS)
    return ~needs_change_review(source_file, change_status) & F.coalesce(done, F.lit(False))


def kept_reasons(reasons: Column, legacy: list[str]) -> tuple[Column, Column]:
    """Review reasons without legacy ones, and the status that they leave."""
    left = F.array_except(reasons, F.array(*[F.lit(x) for x in legacy]))
    return left, F.when(F.size(left) > 0, "needs_review").otherwise("finalized")


def distinct_texts(values: Column) -> Column:
    """Non-empty texts, each where it is first."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != ""))


def overlaid(lookup: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Members as a lookup knows them, overlaid by what a report says; either may lack them."""
    both = lookup.select(key, *columns).join(metadata.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns]), key, "full_outer")
    return both.select(key, *[F.coalesce(f"_m_{c}", c).alias(c) for c in columns])


def normalised_record(label: Column, fallback: Column, text: Column, sentences: Column) -> tuple[Column, Column]:
    """A record's label, else the fallback, else Unclassified; its text, else its cited sentences."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(label), blank(fallback), F.lit("Unclassified")), F.coalesce(blank(text), F.array_join(distinct_texts(sentences), " "))


# ---- starter data and exports ----------------------------------------------------------------------------------------


def known_scopes(frames: list[tuple[str, DataFrame]], scope: list[str]) -> DataFrame:
    """The scopes that any of several tables has, by kind."""
    out = None
    for kind, frame in frames:
        own = frame.select(F.lit(kind).alias("kind"), *scope).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def missing_only(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """What an import adds: rows whose scope is not there yet."""
    return incoming.join(stored.select(*key).distinct(), key, "left_anti")


def preferred(first: DataFrame, second: DataFrame, scope: list[str]) -> DataFrame:
    """The rows of the first source, and of the second those whose scope the first lacks."""
    return first.withColumn("origin", F.lit("database")).unionByName(missing_only(first, second, scope).withColumn("origin", F.lit("files")).select(*first.columns, "origin"))


def with_members(rows: DataFrame, members: DataFrame, details: DataFrame, row: str, member: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows joined with their members and these with their details, as an export needs them, and the members that have no
    details at all, which an export must not pass over."""
    own = members.select(row, member, *[F.col(c).alias(f"_o_{c}") for c in columns])
    told = rows.join(own, row).join(details.select(member, *columns, F.lit(True).alias("_known")), member, "left")
    lost = told.where("_known is null").select(row, member)
    return told.select(row, member, *[F.coalesce(f"_o_{c}", c).alias(c) for c in columns]), lost


def export_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of several shapes under the union of their columns, in order of first appearance."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
