"""Numbers in table cells: kinds, exact decimals, scales, dates and lengths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of currencies and dashes that stand for nothing.
CURRENCY = "$€£¥"
DASHES = ("-", "–", "—", "−")
#: Words that scale a table's numbers.
SCALES = {"thousand": 3, "million": 6, "billion": 9}
#: Points per unit of length.
POINTS = {"pt": 1.0, "px": 0.75, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4, "em": 12.0, "rem": 12.0, "pc": 12.0}


def cell_kind_and_number(raw: Column) -> tuple[Column, Column]:
    """Whether a cell is blank, dash, text or number, and the exact number; parentheses are a minus."""
    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), rf"[{CURRENCY}%]", ""))
    wrapped = s.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(F.when(wrapped, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s), r"\s+", "")
    is_number = inner.rlike(r"^[-−+]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?$") & inner.rlike(r"\d")
    value = F.regexp_replace(F.replace(inner, F.lit("−"), F.lit("-")), "[,+]", "").try_cast("decimal(38,6)")
    kind = F.when(s == "", "blank").when(s.isin(*DASHES), "dash").when(is_number, "number").otherwise("text")
    return kind, F.when(kind == "number", F.when(wrapped, -value).otherwise(value))


def scale_of(text: Column) -> Column:
    """The power of ten that the last scale word names; null without one."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(thousand|million|billion)s?"), F.lit(1))
    last = F.get(found, F.size(found) - 1)
    out = F.lit(None).cast("int")
    for word, power in SCALES.items():
        out = F.when(last == word, power).otherwise(out)
    return out


def date_of(text: Column) -> Column:
    """A date written as 2024-12-31, December 31, 2024 or 12/31/2024."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "M/d/yyyy"))


def points(length: Column) -> Column:
    """A CSS length in points; null for other units."""
    value, unit = F.regexp_extract(length, r"^\s*(-?\d*\.?\d+)\s*([a-z]+)\s*$", 1).try_cast("double"), F.regexp_extract(length, r"([a-z]+)\s*$", 1)
    out = F.lit(None).cast("double")
    for name, factor in POINTS.items():
        out = F.when(unit == name, value * factor).otherwise(out)
    return out


def decimal_text(value: Column) -> Column:
    """A decimal without zeros that say nothing."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def money(value: Column, unit: Column) -> Column:
    """A value for people, by its unit."""
    return F.when(unit == "%", F.concat(F.format_number(value, 2), F.lit("%"))).when(unit == "USD", F.concat(F.lit("$"), F.format_number(value, 0))).otherwise(F.format_number(value, 2))
