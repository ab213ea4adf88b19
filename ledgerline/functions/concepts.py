"""Tagged facts as they come: identity of contexts, exact amounts, periods, dimensions in two syntaxes, JSON access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Data types of amounts, as taxonomies name them.
NUMERIC_TYPE = r"(?i)(monetary|shares|pershare|decimal|integer|percent|pure|area|volume|mass|energy)\w*itemtype$"


def is_metric(abstract: Column, period_type: Column, data_type: Column) -> Column:
    """Whether a taxonomy's concept is a number that a filing can report."""
    return ~F.coalesce(abstract, F.lit(False)) & period_type.isin("instant", "duration") & data_type.rlike(NUMERIC_TYPE)


def fiscal_anniversary(year_end: Column, year: Column) -> Column:
    """The fiscal year's end in another year; 28 February for a leap day that the year lacks."""
    last = F.day(F.last_day(F.make_date(year, F.month(year_end), F.lit(1))))
    return F.make_date(year, F.month(year_end), F.least(F.day(year_end), last))


def fiscal_period_matches(instant: Column, start: Column, end: Column, year: Column, fiscal_year: Column, year_end: Column) -> Column:
    """Whether a fact's period is that fiscal year: an instant within 14 days of the anniversary of the filing's year end,
    or 350 to 380 days that end there."""
    expected = fiscal_anniversary(year_end, F.year(year_end) - (fiscal_year - year))
    near = F.abs(F.datediff(F.coalesce(instant, end), expected)) <= 14
    return F.coalesce(near & (instant.isNotNull() | (F.datediff(end, start) + 1).between(350, 380)), F.lit(False))


def valid_dimensions(dimensions: Column) -> Column:
    """Whether every axis (``axis`` of the structs) and member is named, and no axis twice."""
    axes = F.transform(dimensions, lambda d: F.trim(d["axis"]))
    named = F.forall(dimensions, lambda d: (F.trim(F.coalesce(d["axis"], F.lit(""))) != "") & (F.trim(F.coalesce(d["member"], F.lit(""))) != ""))
    return named & (F.size(F.array_distinct(axes)) == F.size(axes))


def context_key(period: Column, unit: Column, dimensions: Column) -> Column:
    """What makes two facts of a concept the same context; the order of dimensions does not count."""
    return F.to_json(F.struct(period.alias("period"), unit.alias("unit"), F.array_sort(dimensions).alias("dimensions")))


def amount_key(status: Column, value: Column) -> Column:
    """Exact amounts as text, nil as a value of its own; null for what is no finite number."""
    exact = value.try_cast("decimal(38,10)")
    text = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when((status == "nil") & value.isNull(), "nil").when(status == "reported", text)


def dimensions_of(fact: Column) -> Column:
    """Dimensions of a fact's JSON in either syntax: a list of {axis, member} or an object of axis: member."""
    listed = F.from_json(F.get_json_object(fact, "$.dimensions"), "array<struct<axis:string,member:string>>")
    mapped = F.map_entries(F.from_json(F.get_json_object(fact, "$.segment"), "map<string,string>"))
    keyed = F.transform(mapped, lambda e: F.struct(e["key"].alias("axis"), e["value"].alias("member")))
    return F.array_sort(F.coalesce(listed, keyed, F.array().cast("array<struct<axis:string,member:string>>")))


def fact_of(fact: Column) -> Column:
    """A fact's JSON in one form: period, unit, dimensions, and status reported, nil or invalid with the exact value."""
    at = lambda p: F.get_json_object(fact, p)
    value = at("$.value")
    nil = F.coalesce(at("$.nil").cast("boolean"), F.lit(False))
    amount = F.regexp_replace(value, ",", "").try_cast("decimal(38,6)")
    status = F.when(nil & value.isNull(), "nil").when(~nil & amount.isNotNull(), "reported").otherwise("invalid")
    period = F.coalesce(at("$.period.instant"), F.concat_ws("/", at("$.period.startDate"), at("$.period.endDate")))
    return F.struct(F.nullif(period, F.lit("")).alias("period"), at("$.unit").alias("unit"), dimensions_of(fact).alias("dimensions"), status.alias("status"), F.when(status == "reported", amount).alias("value"))


def pointer_path(pointer: str) -> str:
    """A JSON pointer as the path that variant_get and get_json_object take."""
    if pointer in ("", "/"):
        return "$"
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.lstrip("/").split("/")]
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def at_pointer(json: Column, pointer: str, kind: str = "string") -> Column:
    """What a JSON pointer names; null where there is nothing or it is of another kind."""
    return F.try_variant_get(F.try_parse_json(json), pointer_path(pointer), kind)


def list_or_empty(json: Column, path: str) -> Column:
    """The elements at a path as JSON texts if it holds a list, else none: a guard against objects and scalars."""
    found = F.get_json_object(json, path)
    return F.when(found.startswith("["), F.from_json(found, "array<string>")).otherwise(F.array().cast("array<string>"))


def number_or_null(text: Column) -> Column:
    """An empty text is no number."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def any_like(text: Column, patterns: list[str]) -> Column:
    """Whether a text fits any of the LIKE patterns, in either case."""
    low = F.lower(text)
    fits = F.lit(False)
    for p in patterns:
        fits = fits | low.like(p.lower())
    return fits


def stamp(time: Column) -> Column:
    """A time as it is shown."""
    return F.date_format(time, "yyyy-MM-dd HH:mm")
