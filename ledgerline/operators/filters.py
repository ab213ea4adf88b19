"""Predicates and cards over the table of changes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T

DEFAULT_LIMIT, MAX_LIMIT = 20, 50


@dataclass(frozen=True)
class Filters:
    """What a question asks for; empty fields ask nothing."""

    companies: tuple[str, ...] = ()
    previous_year: int | None = None
    current_year: int | None = None
    items: tuple[str, ...] = ()
    change_types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    relationships: tuple[str, ...] = ()
    match_ids: tuple = ()
    material: str | None = None
    min_materiality: float | None = None
    min_strict: bool = False
    max_confidence: float | None = None
    max_strict: bool = False
    limit: int | None = None
    skip: frozenset[str] = field(default_factory=frozenset)


def condition(f: Filters) -> Column:
    """All that is asked, joined by AND. A span of several years takes every window within it."""
    wide = f.previous_year is not None and f.current_year is not None and f.current_year - f.previous_year > 1
    c = F.col
    asked: dict[str, Column | None] = {
        "companies": c("company").isin(*f.companies) if f.companies else None,
        "previous_year": None if f.previous_year is None else (c("previous_year") >= f.previous_year if wide else c("previous_year") == f.previous_year),
        "current_year": None if f.current_year is None else (c("current_year") <= f.current_year if wide else c("current_year") == f.current_year),
        "items": c("item").isin(*f.items) if f.items else None,
        "change_types": c("change_type").isin(*f.change_types) if f.change_types else None,
        "statuses": c("status").isin(*f.statuses) if f.statuses else None,
        "relationships": c("relationship").isin(*f.relationships) if f.relationships else None,
        "match_ids": c("match_id").isin(*f.match_ids) if f.match_ids else None,
        "material": None if f.material is None else c("material") == f.material,
        "min_materiality": None if f.min_materiality is None else (c("materiality_score") > f.min_materiality if f.min_strict else c("materiality_score") >= f.min_materiality),
        "max_confidence": None if f.max_confidence is None else (c("confidence_score") < f.max_confidence if f.max_strict else c("confidence_score") <= f.max_confidence),
    }
    return reduce(lambda a, b: a & b, [v for k, v in asked.items() if v is not None and k not in f.skip], F.lit(True))


def limit_of(f: Filters, default: int = DEFAULT_LIMIT) -> int:
    return max(1, min(f.limit or default, MAX_LIMIT))


def not_unchanged() -> Column:
    """Keeps rows without a label."""
    return ~F.col("change_type").eqNullSafe("Unchanged")


def changed_only() -> Column:
    """Drops rows without a label."""
    return F.col("change_type").isNotNull() & (F.col("change_type") != "Unchanged")


def most_material() -> list[Column]:
    return [F.desc_nulls_last("materiality_score"), F.desc_nulls_last("confidence_score"), F.asc("match_id")]


def cards(changes: DataFrame, order: list[Column], limit: int, excerpt: int = 600) -> DataFrame:
    """The first rows in an order, with a short text."""
    top = changes.orderBy(*order).limit(limit)
    return top.select("company", "previous_year", "current_year", "match_id", "item", "status", "relationship", "change_type", "material", F.round("materiality_score", 4).alias("materiality_score"), F.round("confidence_score", 4).alias("confidence_score"), F.substring("text", 1, excerpt).alias("excerpt"))


def search(changes: DataFrame, words: str, f: Filters) -> DataFrame:
    """Rows whose joined fields contain a text, whatever its case."""
    joined = F.lower(F.concat_ws(" ", "company", "item", "status", "text"))
    return changes.where(condition(f) & joined.contains(words.lower()))


def export_rows(changes: DataFrame) -> DataFrame:
    """Rows for a spreadsheet: one line each, no formulas."""
    return changes.select("match_id", "company", "item", T.safe_cell(F.regexp_replace("text", r"[\t\r\n]+", " ")).alias("cell"))
