"""Questions about tagged metrics. Order lines stand in for tagged values: a supplier's number is the company, a part's the
concept, the ship year the filing, the quarter the period, the line status the unit, the return flag of higher lines the
member of a dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import concepts
from ledgerline.operators import metrics, passages
from ledgerline.plans.registry import registry
from ledgerline.sources import stores
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()
TAGGED = """tagged AS (SELECT l_suppkey % 20 AS company, l_partkey % 50 AS concept, CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS period, l_linestatus AS unit,
  CASE WHEN l_linenumber > 3 THEN l_returnflag END AS member, CAST(l_quantity AS BIGINT) AS amount, l_orderkey * 10 + l_linenumber AS source, l_returnflag AS item FROM lineitem)"""
W = f"WITH {TAGGED}"
CONTEXT = ["company", "concept", "period", "unit", "member"]
_SAME = "a.company = b.company AND a.concept = b.concept AND a.period = b.period AND a.unit = b.unit AND a.member IS NOT DISTINCT FROM b.member"
KEPT = f"""ctx AS (SELECT company, concept, period, unit, member, max(year) AS ly FROM tagged GROUP BY ALL),
  latest AS (SELECT DISTINCT a.company, a.concept, a.period, a.unit, a.member, a.amount, b.ly FROM tagged a JOIN ctx b ON {_SAME} AND a.year = b.ly),
  kept AS (SELECT a.* FROM tagged a JOIN latest b ON {_SAME} AND a.amount = b.amount)"""
MERGED = f"""{KEPT}, meta AS (SELECT company, concept, max(year) AS metadata_year, max(item) FILTER (WHERE year = my) AS label, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years,
    string_agg(DISTINCT unit, ',' ORDER BY unit) AS all_unit FROM (SELECT *, max(year) OVER (PARTITION BY company, concept) AS my FROM tagged) GROUP BY ALL),
  merged AS (SELECT meta.*, n_values, scope FROM meta JOIN (SELECT company, concept, count(*) AS n_values, CASE WHEN bool_or(member IS NULL) THEN 'company_wide' ELSE 'dimension_only' END AS scope FROM kept GROUP BY ALL) USING (company, concept))"""


def tagged(s, d):
    li = table(s, d, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 20).alias("company"), (F.col("l_partkey") % 50).alias("concept"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("period"), F.col("l_linestatus").alias("unit"),
        F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).alias("member"), F.col("l_quantity").cast("long").alias("amount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"), F.col("l_returnflag").alias("item"),
    )


def merged(s, d):
    return metrics.merge_by_concept(tagged(s, d), ["company", "concept"], ["period", "unit", "member"], "year", "amount", "member", "item", ["unit"])


def text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"{W}, {MERGED} SELECT company, concept, metadata_year, label, years, all_unit, n_values, scope FROM merged")
def merged_concepts(s, d):
    return merged(s, d).withColumns({"years": text("years"), "all_unit": text("all_unit")})


@query(f"{W}, {KEPT} SELECT company, concept, source FROM kept")
def latest_context_values(s, d):
    return metrics.latest_context_values(tagged(s, d), CONTEXT, "year", "amount").select("company", "concept", "source")


@query(f"{W}, {MERGED} SELECT company, count(*) AS verified_concepts, count(*) FILTER (WHERE scope = 'company_wide') AS company_wide, count(*) FILTER (WHERE scope = 'dimension_only') AS dimension_only, CAST(sum(n_values) AS BIGINT) AS value_records FROM merged GROUP BY 1")
def metric_scope_counts(s, d):
    return metrics.scope_counts(merged(s, d), ["company"])


@query(f"{W} SELECT company, concept, period, unit, member, amount, count(*) AS n_sources, min(source) AS first_source, string_agg(DISTINCT item, ',' ORDER BY item) AS item FROM tagged GROUP BY company, concept, period, unit, member, amount")
def merged_values(s, d):
    return metrics.merged_values(tagged(s, d), [*CONTEXT, "amount"], ["item"], "source").withColumn("item", text("item"))


@query(f"{W} SELECT company, concept, period, unit, member, amount, min(source) AS first, count(*) AS repeats, count(*) OVER (PARTITION BY company, concept, period, unit, member) > 1 AS conflict FROM tagged GROUP BY company, concept, period, unit, member, amount")
def repeats_with_conflicts(s, d):
    return metrics.kept_conflicts(tagged(s, d), CONTEXT, "amount", "source")


@query(f"{W}, v AS (SELECT a.company, a.concept, a.period, a.unit, a.member, count(DISTINCT a.amount) FILTER (WHERE a.year = b.ly) AS amounts, count(DISTINCT a.year) AS versions FROM tagged a JOIN (SELECT company, concept, period, unit, member, max(year) AS ly FROM tagged GROUP BY ALL) b ON {_SAME} GROUP BY ALL) SELECT company, count(*) AS contexts, count(*) FILTER (WHERE amounts <= 1 AND versions > 1) AS superseded, count(*) FILTER (WHERE amounts > 1) AS omitted_as_ambiguous FROM v GROUP BY 1")
def version_diagnostics(s, d):
    return metrics.version_diagnostics(tagged(s, d), CONTEXT, "year", "amount", ["company"])


@query(f"{W} SELECT company, concept, source, row_number() OVER (PARTITION BY company, concept ORDER BY CAST(year AS VARCHAR), CAST(period AS VARCHAR), sha256(coalesce(member, '')), unit, sha256('{{\"end\":\"' || year || '\",\"start\":\"' || period || '\",' || CASE WHEN member IS NULL THEN '' ELSE '\"member\":\"' || member || '\",' END || '\"unit\":\"' || unit || '\",\"source\":' || source || '}}')) AS place FROM tagged")
def ordered_values(s, d):
    t = tagged(s, d)
    end, start = F.col("year").cast("string").alias("end"), F.col("period").cast("string").alias("start")
    order = metrics.value_order(end, start, F.col("member"), F.col("unit"), F.col("source"))
    w = passages.Window.partitionBy("company", "concept").orderBy(*order)
    return t.select("company", "concept", "source", F.row_number().over(w).cast("long").alias("place"))


@query("WITH c AS (SELECT p_name, p_size % 4 AS taxonomy, max(p_retailprice) AS score, bool_or(p_retailprice > 1500) AS available FROM part GROUP BY ALL) SELECT p_name, max(score) AS score, string_agg(DISTINCT CAST(taxonomy AS VARCHAR), ',' ORDER BY CAST(taxonomy AS VARCHAR)) AS taxonomies, bool_or(available) AS available FROM c GROUP BY 1 ORDER BY score DESC, p_name LIMIT 12")
def candidates_of_taxonomies(s, d):
    c = table(s, d, "part").groupBy("p_name", (F.col("p_size") % 4).alias("taxonomy")).agg(F.max("p_retailprice").alias("score"), F.bool_or(F.col("p_retailprice") > 1500).alias("available"))
    return metrics.merged_candidates(c, "p_name", "score", "taxonomy", "available").withColumn("taxonomies", text("taxonomies"))


_BY_NATION = "SELECT n_nationkey AS concept, n_name, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN n_nationkey % 2 = 1 OR year(o_orderdate) % 2 = 0 THEN CAST(year(o_orderdate) AS BIGINT) ELSE o_orderkey END AS amount FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"


def _by_nation(s, d):
    n, c, o = table(s, d, "nation"), table(s, d, "customer"), table(s, d, "orders")
    rows = n.join(c, n.n_nationkey == c.c_nationkey).join(o, o.o_custkey == c.c_custkey)
    year = F.year("o_orderdate")
    amount = F.when((F.col("n_nationkey") % 2 == 1) | (year % 2 == 0), year.cast("long")).otherwise(F.col("o_orderkey"))
    return rows.select(F.col("n_nationkey").alias("concept"), "n_name", year.alias("year"), amount.alias("amount"))


@query(f"WITH f AS ({_BY_NATION}), y AS (SELECT unnest([1994, 1995, 1996, 2150]) AS year) SELECT CAST(y.year AS INT) AS year, CASE WHEN count(amount) = 0 THEN 'missing' WHEN min(amount) = max(amount) THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN min(amount) = max(amount) THEN min(amount) END AS amount, count(amount) AS records FROM y LEFT JOIN f ON f.year = y.year AND n_name = 'NATION_8' GROUP BY y.year")
def metric_by_label(s, d):
    """The metric that a label names, in the years of a question."""
    names = table(s, d, "nation").select(F.col("n_nationkey").alias("concept"), F.regexp_replace(F.lower("n_name"), "_", " ").alias("name"))
    score = F.when(F.col("name") == "nation 8", 95).when(F.col("name").startswith("nation 8"), 92).otherwise(55)
    selected = metrics.selected_concept(names.withColumn("score", score), "concept", "score")
    return metrics.by_year(_by_nation(s, d), selected, [1996, 1995, 1994, 2150], "concept", "year", "amount")


@query(f"{W} SELECT company, concept, source, 'official_concept' AS basis FROM tagged WHERE member IS NULL UNION ALL SELECT company, 1000 AS concept, source, 'component_rule' FROM tagged WHERE concept = 7 AND member = 'A'")
def represented_concepts(s, d):
    t = tagged(s, d).withColumn("concept", F.col("concept").cast("string"))
    out = metrics.represented(t, "concept", "member", {"1000": ("7", "A")})
    return out.select("company", F.col("concept").cast("long").alias("concept"), "source", "basis")


@query("WITH o AS (SELECT l_partkey % 500 AS p, l_suppkey % 10 AS q, CASE WHEN l_tax > 0.02 THEN 2 ELSE 1 END AS acc, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT p_partkey AS k, p_partkey % 500 AS p, p_size % 10 AS q, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 END AS acc FROM part), f AS (SELECT k, sum(n) AS n FROM r JOIN o ON r.p = o.p AND r.q = o.q AND (r.acc IS NULL OR r.acc = o.acc) GROUP BY 1) SELECT k, CAST(coalesce(n, 0) AS BIGINT) AS occurrences, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'unique' ELSE 'repeated' END AS status FROM r LEFT JOIN f USING (k)")
def signature_matches(s, d):
    li, p = table(s, d, "lineitem"), table(s, d, "part")
    told = li.select((F.col("l_partkey") % 500).alias("p"), (F.col("l_suppkey") % 10).alias("q"), F.when(F.col("l_tax") > 0.02, 2).otherwise(1).alias("acc"))
    records = p.select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 500).alias("p"), (F.col("p_size") % 10).alias("q"), F.nullif(F.col("p_partkey") % 3, F.lit(0)).alias("acc"))
    return metrics.signature_matches(records, told, ["p", "q"], "acc", "k")


@query("SELECT p_partkey, p_size % 2 = 0 AND p_type <> 'ECONOMY' AND p_size % 3 > 0 AS metric FROM part")
def metric_concepts(s, d):
    p = table(s, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "xbrli:stringItemType").when(F.col("p_size") % 3 == 1, "xbrli:monetaryItemType").otherwise("num:perShareItemType")
    return p.select("p_partkey", concepts.is_metric(F.col("p_type") == "ECONOMY", F.when(F.col("p_size") % 2 == 0, "instant").otherwise("other"), kind).alias("metric"))


@query("SELECT o_orderkey, abs(date_diff('day', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END, make_date(1996, 2, 29))) <= 14 AND (o_orderkey % 2 = 0 OR o_orderkey % 40 BETWEEN 5 AND 35) AS same_year, abs(date_diff('day', CAST(o_orderdate AS DATE), make_date(1995, 2, 28))) <= 14 AND (o_orderkey % 2 = 0 OR o_orderkey % 40 BETWEEN 5 AND 35) AS year_before FROM orders")
def fiscal_periods(s, d):
    """Periods against a fiscal year that ends on a leap day: instants, and spans of 345 to 384 days."""
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    k = F.col("o_orderkey")
    instant, end = F.when(k % 2 == 0, F.col("day")), F.when(k % 2 == 1, F.col("day"))
    start = F.date_sub(end, (F.lit(344) + k % 40).cast("int"))
    fits = lambda y: concepts.fiscal_period_matches(instant, start, end, F.lit(y), F.lit(1996), F.to_date(F.lit("1996-02-29")))
    return o.select("o_orderkey", fits(1996).alias("same_year"), fits(1995).alias("year_before"))


@query("SELECT l_orderkey, l_returnflag <> l_linestatus AND l_linestatus <> 'O' AS valid, least(l_returnflag, l_linestatus) || greatest(l_returnflag, l_linestatus) AS key, count(*) AS n FROM lineitem GROUP BY ALL")
def dimension_checks(s, d):
    li = table(s, d, "lineitem")
    named = lambda c, m: F.struct(c.alias("axis"), m.alias("member"))
    dims = F.array(named(F.col("l_returnflag"), F.lit("x")), named(F.col("l_linestatus"), F.when(F.col("l_linestatus") == "O", " ").otherwise("y")))
    key = F.from_json(concepts.context_key(F.lit("p"), F.lit("u"), F.transform(dims, lambda x: x["axis"])), "struct<dimensions:array<string>>")["dimensions"]
    return li.select("l_orderkey", concepts.valid_dimensions(dims).alias("valid"), F.array_join(key, "").alias("key")).groupBy("l_orderkey", "valid", "key").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'a/b' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS period, CASE WHEN l_linenumber % 4 = 0 THEN 'nil' WHEN l_linenumber % 5 = 0 THEN 'invalid' ELSE 'reported' END AS status, CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 5 <> 0 THEN CAST(l_quantity * 1000 AS DOUBLE) END AS value, CASE WHEN l_linenumber % 2 = 0 THEN 'ax=' || l_returnflag ELSE 'ax=' || l_linestatus END AS dimensions FROM lineitem")
def normalised_facts(s, d):
    """Facts as JSON in both syntaxes of dimensions, nil ones and wrong ones, in one form."""
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber")
    value = F.when(n % 4 == 0, "null").when(n % 5 == 0, '"n/a"').otherwise(F.concat(F.lit('"'), F.format_number(F.col("l_quantity") * 1000, 1), F.lit('"')))
    period = F.when(n % 3 == 0, '{"startDate":"a","endDate":"b"}').otherwise(F.concat(F.lit('{"instant":"'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('"}')))
    dims = F.when(n % 2 == 0, F.concat(F.lit('"dimensions":[{"axis":"ax","member":"'), "l_returnflag", F.lit('"}]'))).otherwise(F.concat(F.lit('"segment":{"ax":"'), "l_linestatus", F.lit('"}')))
    json = F.concat(F.lit('{"nil":'), (n % 4 == 0).cast("string"), F.lit(',"unit":"u","value":'), value, F.lit(',"period":'), period, F.lit(","), dims, F.lit("}"))
    out = li.select("l_orderkey", "l_linenumber", concepts.fact_of(json).alias("f"))
    joined = F.array_join(F.transform("f.dimensions", lambda x: F.concat_ws("=", x["axis"], x["member"])), ",")
    return out.select("l_orderkey", "l_linenumber", "f.period", "f.status", F.col("f.value").cast("double").alias("value"), joined.alias("dimensions"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(0 AS BIGINT) AS listed, CAST(json_extract(props, '$.k') AS DOUBLE) AS number, event_type LIKE 'p%' OR event_type LIKE '%w' AS fits, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def json_guards(s, d):
    """JSON pointers, list guards, numbers, patterns and shown times."""
    e = table(s, d, "events")
    return e.select(
        "event_id", concepts.at_pointer(F.col("props"), "/k", "long").alias("k"), F.size(concepts.list_or_empty(F.col("props"), "$.k")).cast("long").alias("listed"),
        concepts.number_or_null(concepts.at_pointer(F.col("props"), "/k")).alias("number"), concepts.any_like(F.col("event_type"), ["P%", "%w"]).alias("fits"), concepts.stamp(F.col("ts")).alias("shown"),
    )


@query("SELECT o_custkey, 'metrics' AS level, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'values', count(DISTINCT (o_orderstatus, o_orderpriority)) FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'sources', count(*) FROM orders GROUP BY 1")
def stored_levels(s, d):
    """A nested export in its tables, counted by level."""
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    whole = stores.nested(o, [(["o_custkey", "o_orderstatus", "o_orderpriority"], "sources", ["o_orderkey"]), (["o_custkey", "o_orderstatus"], "values", ["o_orderpriority", "sources"]), (["o_custkey"], "metrics", ["o_orderstatus", "values"])])
    levels = metrics.stored_levels(whole, "o_custkey", "metrics", "values", "sources")
    count = lambda k: levels[k].groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", F.lit(k).alias("level"), "n")
    return count("metrics").union(count("values")).union(count("sources"))
