"""Comparisons between organisations: what was compared, which run holds, and what had no counterpart."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import windows


def flatten(reports: DataFrame) -> dict[str, DataFrame]:
    """Nested reports as targets, results and comparisons."""
    key = ["target", "fiscal_year"]
    targets = reports.select(*key, F.explode("comparisons").alias("c")).select(*key, "c.*")
    results = targets.select(*key, "target_disclosure_id", F.explode_outer("peer_results").alias("r")).select(*key, "target_disclosure_id", "r.*")
    pairs = results.select(*key, "target_disclosure_id", "peer_ticker", F.posexplode("comparisons").alias("comparison_index", "p")).select(*key, "target_disclosure_id", "peer_ticker", "comparison_index", "p.*")
    return {"targets": targets.drop("peer_results"), "results": results.drop("comparisons"), "comparisons": pairs}


def source_key(peers) -> F.Column:
    """Peers as a set, however they are written."""
    return F.array_sort(F.array_distinct(F.transform(peers, lambda p: F.upper(F.trim(p)))))


def coverage(runs: DataFrame, companies: list[str], year: int | None) -> DataFrame:
    """Runs that have any of the companies as target or peer."""
    wanted = F.array(*[F.lit(c) for c in companies])
    hit = F.array_contains(wanted, F.col("target")) | F.arrays_overlap("peers", wanted)
    return runs.where(hit if year is None else hit & (F.col("fiscal_year") == year))


def wanted_pairs(companies: list[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(set(companies)), 2))


def lookup(pairs: DataFrame, a: str, b: str, limit: int = 20) -> DataFrame:
    """Comparisons of two companies, whichever is the target, of runs that none supersedes; same topics first."""
    both = F.array_sort(F.array("target", "peer")) == F.array_sort(F.array(F.lit(a), F.lit(b)))
    held = windows.latest(pairs.where(both), ["target_disclosure_id", "peer"], ["saved_at", "run_id"]).where(~F.col("superseded"))
    return held.orderBy((F.col("relationship") == "same_topic").desc(), F.desc_nulls_last("score"), F.asc("comparison_id")).limit(limit)


def without_counterpart(results: DataFrame) -> DataFrame:
    """Targets whose newest result for a peer is no comparison."""
    newest = windows.latest(results, ["target_disclosure_id", "peer"], ["saved_at", "run_id"])
    return newest.where(~F.col("superseded") & (F.col("status") != "compared")).drop("superseded")


def with_yearly_context(rows: DataFrame, alignments: DataFrame, member: str) -> DataFrame:
    """Rows with the year-over-year labels of their disclosures in the windows around, in order."""
    context = alignments.groupBy(member).agg(F.array_sort(F.collect_list(F.struct("window", "label"))).alias("context"))
    return rows.join(context, member, "left")
