"""Questions about numeric facts: versions, conflicts, growth, ratios, cells. Order lines stand in for tagged facts: a part
is the concept, a supplier the company, the ship date the period, the order the filing that tells it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import ladders, numbers
from ledgerline.operators import diff, facts
from ledgerline.plans.registry import registry
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()
FACTS = "facts AS (SELECT l_suppkey AS company, l_partkey AS concept, CAST(year(l_shipdate) AS INT) AS year, l_orderkey AS filing, CAST(l_quantity AS DECIMAL(18,4)) AS amount FROM lineitem)"
W = f"WITH {FACTS} "


def fact_rows(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("company"), F.col("l_partkey").alias("concept"), F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("filing"), F.col("l_quantity").cast("decimal(18,4)").alias("amount"))


@query(W + "SELECT company, year, filing, string_agg(DISTINCT CAST(amount AS VARCHAR), ',' ORDER BY CAST(amount AS VARCHAR)) AS amounts FROM facts JOIN (SELECT company, year, max(filing) AS newest FROM facts GROUP BY ALL) USING (company, year) WHERE filing = newest GROUP BY ALL")
def latest_filing_keeps_all(s, d):
    held = facts.latest_values(fact_rows(s, d), ["company", "year"], "filing", "amount")
    return held.select("company", "year", "filing", F.array_join(F.array_sort(F.transform("amounts", lambda a: a.cast("string"))), ",").alias("amounts"))


@query(W + "SELECT company, concept, max(filing) AS filing, CASE WHEN min(amount) = max(amount) THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN min(amount) = max(amount) THEN CAST(min(amount) AS DOUBLE) END AS amount FROM facts JOIN (SELECT company, concept, max(filing) AS newest FROM facts GROUP BY ALL) USING (company, concept) WHERE filing = newest GROUP BY company, concept")
def latest_filing_or_ambiguous(s, d):
    return facts.resolved(fact_rows(s, d), ["company", "concept"], "filing", "amount").withColumn("amount", F.col("amount").cast("double"))


@query(W + "SELECT concept, year, CASE WHEN low IS NULL THEN 'missing' WHEN low = high THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN low = high THEN CAST(low AS DOUBLE) END AS amount FROM (SELECT p_partkey AS concept, y.year FROM part, (SELECT DISTINCT year FROM facts) y) LEFT JOIN (SELECT concept, year, min(amount) AS low, max(amount) AS high FROM facts GROUP BY ALL) USING (concept, year)")
def metric_status_per_year(s, d):
    rows = fact_rows(s, d)
    years = F.broadcast(rows.select("year").distinct())  # as many as there are fiscal years
    wanted = table(s, d, "part").select(F.col("p_partkey").alias("concept")).crossJoin(years)
    return facts.status_of(rows, wanted, ["concept", "year"], "amount").withColumn("amount", F.col("amount").cast("double"))


@query(W + ", t AS (SELECT company, year, sum(amount) AS v FROM facts GROUP BY ALL) SELECT a.company, a.year AS from_year, b.year AS to_year, CAST(a.v AS DOUBLE) AS old_value, CAST(b.v AS DOUBLE) AS new_value, round_even(CAST(b.v - a.v AS DOUBLE) * 100 / CAST(abs(a.v) AS DOUBLE), 2) AS growth_pct FROM t a JOIN t b ON a.company = b.company AND b.year = a.year + 1 WHERE a.v <> 0")
def growth_between_years(s, d):
    v = fact_rows(s, d).groupBy("company", "year").agg(F.sum("amount").alias("v"))
    out = facts.growth(v, ["company"], "year", "v")
    return out.select("company", "from_year", "to_year", *[F.col(c).cast("double").alias(c) for c in ("old_value", "new_value", "growth_pct")])


@query("WITH t AS (SELECT l_suppkey AS company, CAST(year(l_shipdate) AS INT) AS year, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS r, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS n FROM lineitem GROUP BY ALL) SELECT company, year, 'accepted / open' AS ratio, round_even(CAST(a AS DOUBLE) / n, 6) AS value FROM t WHERE n <> 0 AND a IS NOT NULL UNION ALL SELECT company, year, 'returned / accepted', round_even(CAST(r AS DOUBLE) / a, 6) FROM t WHERE a <> 0 AND r IS NOT NULL")
def standard_ratios(s, d):
    li = table(s, d, "lineitem")
    v = li.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("concept")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("value"))
    out = facts.ratios(v, ["company", "year"], "concept", "value", {"accepted / open": ("A", "N"), "returned / accepted": ("R", "A")})
    return out.withColumn("value", F.col("value").cast("double"))


@query("SELECT o_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 300 AND 380 AS annual, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 330 AND 380 AS strict_annual, abs(date_diff('day', make_date(year(l_shipdate), 12, 31), CAST(l_shipdate AS DATE))) <= 14 AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) + 1 BETWEEN 350 AND 380 AS fiscal FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def annual_periods(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("b"))
    a, b = F.col("a"), F.col("b")
    year_end = F.make_date(F.year("b"), F.lit(12), F.lit(31))
    return o.join(li, "o_orderkey").select("o_orderkey", "l_linenumber", facts.annual(a, b).alias("annual"), facts.annual(a, b, 330).alias("strict_annual"), facts.fiscal_year_matches(a, b, year_end).alias("fiscal"))


@query(W + "SELECT company, concept, count(*) AS n, count(DISTINCT amount) AS n_values, CASE WHEN count(DISTINCT amount) = 1 THEN 'same_value' ELSE 'multiple_values' END AS kind FROM facts GROUP BY 1, 2 HAVING count(*) > 1")
def context_variants(s, d):
    return facts.context_variants(fact_rows(s, d), ["company", "concept"], "amount")


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS col, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders), s AS (SELECT o_custkey, col, sum(CASE WHEN NOT f THEN v END) AS t, sum(CASE WHEN f THEN v END) AS x FROM c GROUP BY ALL) SELECT o_custkey, bool_and(coalesce(t = x, false)) AS is_total, count(*) AS columns FROM s GROUP BY 1")
def footer_totals(s, d):
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("col"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return facts.footer_totals(o.join(last, "o_custkey"), "o_custkey", "col", "v", F.col("o_orderkey") == F.col("last"))


@query("WITH r AS (SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey AS review FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey) SELECT s_suppkey, review FROM supplier LEFT JOIN r ON s_nationkey = c_nationkey")
def newest_matching_review(s, d):
    reviews = table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("review"), F.struct(F.col("c_acctbal"), -F.col("c_custkey")).alias("at"))
    rows = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    return facts.newest_review(rows, reviews, "key", "at").select("s_suppkey", "review")


CELLS = "WITH o AS (SELECT c_custkey % 50 AS r, c_mktsegment AS col, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer WHERE c_custkey % 7 <> 0 GROUP BY ALL), n AS (SELECT c_custkey % 50 + 3 AS r, c_mktsegment AS col, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer GROUP BY ALL) "


@query(CELLS + "SELECT r, col, CAST(o.v AS DOUBLE) AS old_value, CAST(n.v AS DOUBLE) AS new_value, CASE WHEN n.r IS NULL THEN 'removed' WHEN o.r IS NULL THEN 'added' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS change, CAST(n.v - o.v AS DOUBLE) AS delta FROM (SELECT r, col, v, r AS k FROM o) o FULL JOIN (SELECT r, col, v FROM n) n USING (r, col)")
def cell_comparison(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") % 50).alias("r"), F.col("c_mktsegment").alias("col"), F.col("c_acctbal").cast("decimal(18,2)").alias("v"), "c_custkey")
    total = lambda x: x.groupBy("r", "col").agg(F.sum("v").alias("v"))
    out = diff.cell_changes(total(c.where("c_custkey % 7 <> 0")), total(c.withColumn("r", F.col("r") + 3)), ["r", "col"], "v")
    return out.select("r", "col", *[F.col(x).cast("double").alias(x) for x in ("old_value", "new_value", "delta")], "change")


@query("WITH k AS (SELECT p_type || '/' || p_size || '/' || p_brand AS key, p_partkey, p_partkey % 2 = 1 AS new FROM part), a AS (SELECT key, min(p_partkey) AS old_id FROM k WHERE NOT new GROUP BY 1 HAVING count(*) = 1), b AS (SELECT key, min(p_partkey) AS new_id FROM k WHERE new GROUP BY 1 HAVING count(*) = 1) SELECT key, old_id, new_id FROM a JOIN b USING (key)")
def unique_key_pairs(s, d):
    p = table(s, d, "part").select(F.concat_ws("/", "p_type", F.col("p_size").cast("string"), "p_brand").alias("key"), "p_partkey")
    return diff.unique_pairs(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "key", "p_partkey")


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'old_only' WHEN a.k IS NULL THEN 'new_only' ELSE 'matched' END AS match FROM a FULL JOIN b ON a.k = b.k")
def title_full_outer(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    of = lambda x: li.where(F.col("l_returnflag") == x).select("k").distinct()
    return diff.full_pairs(of("A"), of("R"), ["k"])


@query("WITH c AS (SELECT l_partkey, l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'N') AS o, count(*) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(least(o, n)) AS BIGINT) AS shared, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS old_only, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS new_only FROM c GROUP BY 1")
def multiset_difference(s, d):
    return diff.diff_totals(table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag"), ["l_suppkey"], "l_partkey", F.col("l_returnflag") == "N")


@query("SELECT l_suppkey, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A') AS both, CASE WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A') THEN 'mixed' WHEN bool_or(l_returnflag = 'A') THEN 'inside' ELSE 'outside' END AS status FROM lineitem GROUP BY 1")
def membership_lattice(s, d):
    g = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("i"), F.bool_or(F.col("l_returnflag") != "A").alias("o"))
    return g.select("l_suppkey", (F.col("i") & F.col("o")).alias("both"), ladders.status_lattice(F.col("i"), F.col("o")).alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'blank' WHEN c_custkey % 5 = 1 THEN 'dash' WHEN c_custkey % 5 = 2 THEN 'text' ELSE 'number' END AS kind, CASE WHEN c_custkey % 5 = 3 THEN -CAST(c_custkey * 1000.5 AS DECIMAL(38,6)) WHEN c_custkey % 5 = 4 THEN CAST(round(c_acctbal, 2) AS DECIMAL(38,6)) END AS number FROM customer")
def numeric_cells(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, " $ ").when(k % 5 == 1, "—").when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, F.concat(F.lit("$ ("), F.format_number(k * 1000.5, 1), F.lit(")"))).otherwise(F.concat(F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string"), F.lit(" %")))
    kind, number = numbers.cell_kind_and_number(raw)
    return c.select("c_custkey", kind.alias("kind"), number.cast("decimal(38,6)").alias("number"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def dates_in_three_forms(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return o.select("o_orderkey", numbers.date_of(text).alias("day"))


@query("SELECT n_nationkey, (ARRAY[3, 6, 9, NULL])[n_nationkey % 4 + 1] AS scale, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey * 0.75 AS DOUBLE) ELSE CAST(n_nationkey * 12.0 AS DOUBLE) END AS points, rtrim(rtrim(ltrim(CAST(CAST(n_nationkey AS DECIMAL(18,3)) / 4 AS DECIMAL(18,3))::VARCHAR, '0'), '0'), '.') AS dec FROM nation")
def scales_and_lengths(s, d):
    n = table(s, d, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    phrase = F.when(k % 4 == 0, "in Thousands").when(k % 4 == 1, "thousands, then millions").when(k % 4 == 2, "$ Billion").otherwise("in euros")
    length = F.concat(k.cast("string"), F.when(k % 2 == 0, "px").otherwise("em"))
    dec = F.regexp_replace(numbers.decimal_text((k.cast("decimal(18,3)") / 4).cast("decimal(18,3)")), "^0+", "")
    return n.select("n_nationkey", numbers.scale_of(phrase).alias("scale"), numbers.points(length).alias("points"), dec.alias("dec"))


@query("SELECT c_nationkey, count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS digest_0, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS digest_1, CAST(sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)) AS BIGINT) AS digest_2, CAST(sum(CAST('0x' || substr(h, 25, 8) AS BIGINT)) AS BIGINT) AS digest_3, CAST(sum(CAST('0x' || substr(h, 33, 8) AS BIGINT)) AS BIGINT) AS digest_4, CAST(sum(CAST('0x' || substr(h, 41, 8) AS BIGINT)) AS BIGINT) AS digest_5, CAST(sum(CAST('0x' || substr(h, 49, 8) AS BIGINT)) AS BIGINT) AS digest_6, CAST(sum(CAST('0x' || substr(h, 57, 8) AS BIGINT)) AS BIGINT) AS digest_7 FROM (SELECT DISTINCT c_nationkey, sha256('=' || c_custkey || chr(1) || '=' || c_name) AS h FROM customer) GROUP BY 1")
def set_digests(s, d):
    return diff.set_digest(table(s, d, "customer"), ["c_nationkey"], ["c_custkey", "c_name"])


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(s, d):
    li = table(s, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sum_base"), F.count("*").alias("n"))


@query("SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def four_way_join(s, d):
    """Facts with their dimensions; Spark broadcasts those whose size on disk allows it."""
    o = table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")).join(table(s, d, "region").select("r_regionkey"), "r_regionkey")
    return o.join(c, "o_custkey").join(n, "n_nationkey").groupBy("n_name", "year").agg(F.sum("v").alias("total"))
