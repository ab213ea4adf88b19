"""The question layer: a question's filters and intent, and the frames that answer it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import aggregates as A
from ledgerline.operators import filters, windows
from ledgerline.operators.filters import Filters

#: Words of a question and the intent they ask for, first match wins.
INTENTS = (
    ("match_detail", r"\bmatch\s+\d+\b"),
    ("disagreements", r"\bdisagree"),
    ("low_confidence", r"\b(low(est)?|least)[ -]confiden|\bconfidence (below|under)"),
    ("compare", r"\bcompar|\bversus\b|\bvs\.?\b"),
    ("distribution", r"\bdistribution\b|\bbreakdown\b|\bby (status|item|company|type)\b"),
    ("count", r"\bhow many\b|\bnumber of\b|\bcount\b"),
    ("material", r"\bmaterial\b|\bimportant\b"),
    ("summary", r"\bsummar|\boverview\b"),
)
TYPE_WORDS = {"new": "New", "added": "New", "removed": "Removed", "deleted": "Removed", "expanded": "Expanded", "reduced": "Reduced", "reworded": "Reworded", "modified": "Modified", "unchanged": "Unchanged"}
DIMENSIONS = {"status": "status", "item": "item", "company": "company", "type": "change_type", "relationship": "relationship"}
NUMBERS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten".split())}


@dataclass(frozen=True)
class Plan:
    intent: str
    filters: Filters
    group_by: tuple[str, ...] = ()
    exclude_unchanged: bool = False


def parse(question: str, companies: tuple[str, ...] = (), items: tuple[str, ...] = ()) -> Plan:
    """A question's plan. Companies and items are found among the known ones, in the order they are named."""
    q = question.lower()
    named = lambda known: tuple(sorted((k for k in known if re.search(rf"\b{re.escape(k.lower())}\b", q)), key=lambda k: q.index(k.lower())))
    years = [int(y) for y in re.findall(r"\b(20\d\d)\b", q)]
    top = re.search(r"\b(?:top|first)\s+(\d+|" + "|".join(NUMBERS) + r")\b", q)
    limit = None if top is None else int(top[1]) if top[1].isdigit() else NUMBERS[top[1]]
    score = re.search(r"materiality\s+(above|over|at least|>=|>)\s*(0?\.\d+|1(?:\.0+)?)", q)
    sure = re.search(r"confidence\s+(below|under|at most|<=|<)\s*(0?\.\d+|1(?:\.0+)?)", q)
    f = Filters(
        companies=named(companies), items=named(items), change_types=tuple(dict.fromkeys(v for k, v in TYPE_WORDS.items() if re.search(rf"\b{k}\b", q))),
        previous_year=min(years) if len(years) > 1 else None, current_year=max(years) if years else None,
        match_ids=tuple(int(x) for x in re.findall(r"\bmatch\s+(\d+)\b", q)), limit=limit,
        min_materiality=float(score[2]) if score else None, min_strict=bool(score) and score[1] in ("above", "over", ">"),
        max_confidence=float(sure[2]) if sure else None, max_strict=bool(sure) and sure[1] in ("below", "under", "<"),
    )
    intent = next((name for name, words in INTENTS if re.search(words, q)), "list")
    dims = tuple(DIMENSIONS[w] for w in re.findall(r"\bby ([a-z]+)(?: and ([a-z]+))?", q) for w in w if w in DIMENSIONS)
    return Plan(intent, f, dims, bool(re.search(r"\bchange[sd]?\b", q)) and not f.change_types)


def follow_up(plan: Plan, before: Plan | None) -> Plan:
    """What a following question leaves out is as it was."""
    if before is None:
        return plan
    a, b = plan.filters, before.filters
    years = (a.previous_year, a.current_year) if a.current_year else (b.previous_year, b.current_year)
    return replace(plan, filters=replace(a, companies=a.companies or b.companies, items=a.items or b.items, previous_year=years[0], current_year=years[1]))


def frames(plan: Plan, changes: DataFrame) -> dict[str, DataFrame]:
    """Named frames that answer a plan; nothing runs before they are asked for."""
    f = plan.filters
    rows = changes.where(filters.condition(f))
    if plan.exclude_unchanged:
        rows = rows.where(filters.not_unchanged())
    card = lambda r, order=None, n=filters.DEFAULT_LIMIT: filters.cards(r, order or filters.most_material(), filters.limit_of(f, n))
    yes = F.col("material") == "Yes"
    dims = list(plan.group_by) or ["change_type"]
    answers: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "match_detail": lambda: {"match_detail": rows.orderBy("match_id")},
        "material": lambda: {"counts": A.count_by(rows.where(yes), *A.RUN), "cards": card(rows.where(yes))},
        "count": lambda: {"counts": A.count_by(rows.where(filters.changed_only()) if plan.exclude_unchanged else rows, *A.RUN), "by_item": A.count_by(rows, "item"), "examples": card(rows, n=8)},
        "distribution": lambda: {"distribution": A.distribution(rows, dims, yes, "materiality_score"), "examples": card(rows.where(filters.not_unchanged()), n=5)},
        "compare": lambda: {"profile": A.profile(rows), "top": windows.top_per_group(rows.where(yes), ["company", "previous_year"], filters.most_material(), 3)},
        "low_confidence": lambda: {"histogram": A.confidence_histogram(rows), "cards": card(rows, [F.asc("confidence_score"), F.desc_nulls_last("materiality_score"), F.asc("match_id")], 12)},
        "disagreements": lambda: {"pairs": A.disagreement_matrix(rows), "rate": A.agreement(rows)},
        "summary": lambda: {"by_item": A.changes_by_item(rows), "kpis": A.kpis(rows), "cards": card(rows.where(yes), n=8)},
        "list": lambda: {"counts": A.count_by(rows, *A.RUN), "cards": card(rows)},
    }
    return answers[plan.intent]()


def answer(question: str, changes: DataFrame, companies: tuple[str, ...] = (), items: tuple[str, ...] = (), before: Plan | None = None) -> tuple[Plan, dict[str, DataFrame]]:
    plan = follow_up(parse(question, companies, items), before)
    return plan, frames(plan, changes)


#: Relations, functions and the row limit of SQL that others wrote. Whatever is not named here may not be called.
ALLOWED, MAX_ROWS = frozenset({"alignment_changes"}), 200
FUNCTIONS = frozenset(
    "count sum avg min max round abs coalesce nullif lower upper trim ltrim rtrim length char_length substring substr concat concat_ws replace regexp_replace regexp_extract "
    "regexp_like like contains startswith endswith split array_join array_contains array_distinct size explode posexplode string_agg listagg collect_list collect_set array_agg "
    "row_number rank dense_rank lag lead first last first_value last_value ntile percent_rank year month quarter day date_trunc to_date extract if ifnull nvl greatest least "
    "floor ceil ceiling power sqrt ln median percentile stddev variance bool_and bool_or count_if any_value max_by min_by cast distinct in and or not".split()
)


def guarded(spark, sql: str, allowed: frozenset[str] = ALLOWED, functions: frozenset[str] = FUNCTIONS) -> DataFrame:
    """A query that only reads allowed relations and calls allowed functions, with a row limit; Spark's own parser says what
    it reads and calls."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError("not a query") from e
    text = plan.toString()
    if re.search(r"'?(InsertInto|CreateTable|DropTable|Command|SetCatalog|CacheTable|Delete|Update|Merge|Truncate|AlterTable|Refresh|Analyze|ScriptTransformation|UnresolvedTableValuedFunction)", text):
        raise ValueError("only queries are allowed")
    with_names = {n.strip().lower() for m in re.findall(r"CTE \[(.*?)\]", text) for n in m.split(",")}
    read = {r.lower() for r in re.findall(r"UnresolvedRelation \[([^\]]+)\]", text)}
    if not read or read - {a.lower() for a in allowed} - with_names:
        raise ValueError(f"may not read {sorted(read - set(allowed))}")
    # names before brackets, outside of texts and comments; as written, so that nothing the parser hides is passed over
    bare = re.sub(r"/\*.*?\*/|--[^\n]*", " ", re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", sql), flags=re.S)
    if "`" in bare:
        raise ValueError("quoted names are not allowed")
    called = {f.lower() for f in re.findall(r"([A-Za-z_][\w.]*)\s*\(", bare)}
    words = {"as", "over", "by", "from", "where", "select", "on", "then", "when", "else", "having", "join", "filter", "using", "exists", "union", "all", "group", "order", "with", "values", "between", "is", "case", "end", "any", "some", "partition", "limit", "decimal", "varchar", "char", "within"}
    if called - functions - words - with_names:
        raise ValueError(f"may not call {sorted(called - functions - words - with_names)}")
    return spark.sql(sql).limit(MAX_ROWS)
