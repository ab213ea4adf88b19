"""Questions about reports and their review. Orders stand for rows of a report, their lines for members, customers for
companies, events for calls and loads; statuses and reasons are derived from keys, the same way in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import reports
from ledgerline.plans.changes import SQL, changes
from ledgerline.plans.registry import registry
from ledgerline.sources import stores
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()


def lines(s, d, *more):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", *more)


def sided(s, d):
    """Orders with the parts of returned and other lines as the two sides' members."""
    li = lines(s, d).groupBy("l_orderkey")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("l_partkey"))))
    return li.agg(of(F.col("l_returnflag") == "R").alias("before"), of(F.col("l_returnflag") != "R").alias("after"))


@query("SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'before' ELSE 'after' END AS side, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_partkey) - 1 AS position, l_partkey AS id FROM lineitem")
def report_members(s, d):
    """Members of both sides, back from nested rows."""
    out = reports.flat_members(sided(s, d), "l_orderkey", {"before": "before", "after": "after"})
    return out.withColumn("position", F.col("position").cast("long"))


@query("SELECT o_custkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY o_orderkey, l_linenumber, l_returnflag) AS text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def two_level_texts(s, d):
    """Texts of a list of lists, in order: lines of orders of customers."""
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    li = lines(s, d).select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"))
    whole = stores.nested(li, [(["l_orderkey"], "parts", ["l_linenumber", "t"])])
    docs = o.join(whole, "l_orderkey", "left").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "parts"))).alias("findings"))
    return reports.two_level_text(docs, "o_custkey", "findings", "parts", "t")


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) - 1 AS place, l_partkey, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey")
def evidence_rows(s, d):
    """Evidence of findings in order, with what a partial catalog knows."""
    f = lines(s, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_partkey"]).alias("ids"))
    catalog = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return reports.evidence_rows(f, "l_orderkey", "ids", catalog, "l_partkey").withColumn("place", F.col("place").cast("long"))


@query("WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_acctbal AS score FROM customer ORDER BY rank LIMIT 25) SELECT rank, c_custkey, score, c_mktsegment FROM h JOIN customer USING (c_custkey) ORDER BY rank")
def rows_in_rank_order(s, d):
    c = table(s, d, "customer")
    best = [r for r in c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_acctbal").collect()]  # a ranked list as retrieval gives it
    hits = s.createDataFrame([(r.c_custkey, k, r.c_acctbal) for k, r in enumerate(best, 1)], "c_custkey long, rank long, score double")
    return reports.in_rank_order(hits, c.select("c_custkey", "c_mktsegment"), "c_custkey").select("rank", "c_custkey", "score", "c_mktsegment")


@query("SELECT l_orderkey, max(p_retailprice) AS score, count(*) AS scored_members FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY 1")
def bridged_scores(s, d):
    """Scores of members as the best of the rows that have them."""
    scores = table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("score"))
    return reports.bridged_scores(scores, lines(s, d), "l_partkey", "l_orderkey", "score")


@query("WITH r AS (SELECT c_custkey, c_nationkey AS k, 1992 + c_custkey % 4 AS low, 1994 + c_custkey % 5 AS high, make_date(1996, 1, 1) + CAST(c_custkey % 900 AS INT) AS built FROM customer), l AS (SELECT CAST(c_nationkey AS INT) AS k, CAST(year(o_orderdate) AS INT) AS year, max(CAST(o_orderdate AS DATE)) AS seen_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0 GROUP BY ALL), m AS (SELECT c_custkey, built, max(seen_at) AS newest_load FROM r LEFT JOIN l ON r.k = l.k AND year BETWEEN low AND high GROUP BY ALL) SELECT c_custkey, newest_load, coalesce(newest_load > built, false) AS stale FROM m")
def stale_reports(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    k = F.col("c_custkey")
    r = c.select("c_custkey", F.col("c_nationkey").alias("k"), (F.lit(1992) + k % 4).alias("low"), (F.lit(1994) + k % 5).alias("high"), F.date_add(F.make_date(F.lit(1996), F.lit(1), F.lit(1)), (k % 900).cast("int")).alias("built"))
    loads = o.where("o_orderkey % 5 = 0").join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("at"))
    return reports.staleness(r, loads, "k", "low", "high", "year", "built", "at").select("c_custkey", "newest_load", "stale")


@query("SELECT p_partkey, CASE WHEN p_size = 1 OR (p_size % 2 = 0 AND p_size % 3 = 0 AND lower(p_brand) <> lower(p_type)) THEN 'existing_pair:' || p_partkey ELSE 'equivalent_title:' || CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE lower(p_type) END END AS section_key FROM part")
def equivalent_sections(s, d):
    p = table(s, d, "part")
    n = F.col("p_size")
    return reports.equivalent_sections(p, "p_partkey", n == 1, F.lower("p_brand"), F.lower("p_type"), n % 2 == 0, n % 3 == 0).select("p_partkey", "section_key")


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 40, l_returnflag = 'R' ORDER BY l_orderkey * 10 + l_linenumber) AS k, count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_suppkey, l_partkey % 40) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') OVER (PARTITION BY l_suppkey, l_partkey % 40) AS o FROM lineitem) SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id FROM c WHERE k > least(n, o)")
def without_unchanged(s, d):
    rows = lines(s, d).select("l_suppkey", (F.col("l_partkey") % 40).alias("key"), (F.col("l_returnflag") == "R").alias("new"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return reports.without_unchanged(rows, ["l_suppkey"], "key", "new", "id").select("l_suppkey", "id")


@query(f"WITH {SQL}, r AS (SELECT company, item, previous_year, current_year, count(*) AS n FROM changes GROUP BY ALL), t AS (SELECT company, item, current_year AS year, 'into' AS w, n FROM r UNION ALL SELECT company, item, previous_year, 'out_of', n FROM r), g AS (SELECT company, item, year, string_agg(w || n, ',' ORDER BY w, n) AS adjacent FROM t GROUP BY ALL) SELECT company, item, CAST(y.year AS INT) AS year, adjacent FROM (SELECT DISTINCT company, item, unnest([2020, 2021, 2024]) AS year FROM changes) y LEFT JOIN g USING (company, item, year)")
def adjacent_windows(s, d):
    r = changes(s, d).groupBy("company", "item", "previous_year", "current_year").agg(F.count("*").alias("n"))
    targets = r.select("company", "item").distinct().withColumn("year", F.explode(F.array(F.lit(2020), F.lit(2021), F.lit(2024))))
    out = reports.adjacent_windows(targets, r, ["company", "item"], "year", "n")
    return out.withColumn("adjacent", F.array_join(F.transform("adjacent", lambda a: F.concat(a["window"], a["n"].cast("string"))), ","))


_YEARS = "y AS (SELECT DISTINCT o_custkey AS company, CAST(year(o_orderdate) AS INT) AS year FROM orders), p AS (SELECT company, year AS previous, lead(year) OVER (PARTITION BY company ORDER BY year) AS current FROM y)"


@query(f"WITH {_YEARS} SELECT * FROM p WHERE current IS NOT NULL")
def consecutive_scopes(s, d):
    y = table(s, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"))
    return reports.consecutive_scopes(y, "company", "year")


@query(f"WITH {_YEARS} SELECT * FROM p WHERE current IS NOT NULL AND (previous = 1996 OR current = 1996)")
def affected_scopes(s, d):
    return reports.affected_pairs(consecutive_scopes(s, d), 1996)


@query("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS reports, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AS finished, (SELECT count(*) FROM supplier WHERE s_suppkey = c_custkey) AS peers FROM customer c")
def report_overviews(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    peers = table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return reports.overviews(c, {"reports": o, "finished": o.where("o_orderstatus = 'F'"), "peers": peers}, "c_custkey")


@query("SELECT l_orderkey, coalesce(min(l_partkey) FILTER (WHERE f), min(l_partkey)) AS first, count(*) FILTER (WHERE f IS FALSE) AS failing FROM (SELECT *, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag = 'A' END AS f FROM lineitem) GROUP BY 1")
def first_passing(s, d):
    passes = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_returnflag") == "A")
    return reports.first_passing(lines(s, d), ["l_orderkey"], "l_partkey", passes)


@query(f"WITH {SQL} SELECT company, 'status' AS what, coalesce(status, 'none') AS value, count(*) AS n FROM changes GROUP BY ALL UNION ALL SELECT company, 'change_type', coalesce(change_type, 'none'), count(*) FROM changes GROUP BY ALL UNION ALL SELECT company, 'semantic_label', coalesce(semantic_label, 'none'), count(*) FROM changes GROUP BY ALL")
def change_summaries(s, d):
    return reports.summary_counts(changes(s, d), ["company"], ["status", "change_type", "semantic_label"])


@query("WITH r AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS b, count(*) FILTER (WHERE l_returnflag <> 'R') AS a FROM lineitem GROUP BY 1) SELECT CASE WHEN a = 0 OR b = 0 THEN 'one_sided' WHEN a = 1 AND b = 1 THEN 'one_to_one' WHEN b = 1 THEN 'split' WHEN a = 1 THEN 'merge' ELSE 'many_to_many' END AS kind, count(*) AS n, CAST(sum(a + b) AS BIGINT) AS members, count(*) FILTER (WHERE l_orderkey % 4 > 0) AS settled FROM r GROUP BY 1")
def grouping_summaries(s, d):
    rows = sided(s, d).withColumn("status", F.when(F.col("l_orderkey") % 4 == 0, "needs_review").otherwise("ai_verified"))
    return reports.grouping_summary(rows, [], "before", "after", "status")


@query("WITH c AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS r FROM lineitem WHERE l_returnflag <> 'N'), u AS (SELECT l_partkey AS k, l_suppkey AS r, count(*) AS times FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) SELECT k, r, coalesce(times, 0) AS times, 'cell' AS \"of\" FROM c LEFT JOIN u USING (k, r) WHERE coalesce(times, 0) <> 1 UNION ALL SELECT k, r, times, 'nothing' FROM u WHERE (k, r) NOT IN (SELECT (k, r) FROM c)")
def cell_coverage(s, d):
    cells = lines(s, d).select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("r"), "l_returnflag")
    return reports.coverage(cells.where("l_returnflag <> 'N'"), cells.where("l_returnflag <> 'A'"), ["k", "r"])


@query("WITH k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 4) SELECT l_suppkey, CAST(count(*) AS INT) AS known, round_even(100.0 * count(c.l_partkey) / count(*), 1) AS cited_pct FROM k LEFT JOIN c USING (l_suppkey, l_partkey) GROUP BY 1")
def citation_shares(s, d):
    """Shares of the ids that a report knows which its rows cite."""
    li = lines(s, d)
    rows = li.groupBy("l_suppkey", "l_orderkey").agg(F.collect_set("l_partkey").alias("known"), F.collect_set(F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") < 4), F.col("l_partkey"))).alias("cited"))
    return reports.citation_share(rows, ["l_suppkey"], "cited", "known")


@query("SELECT event_type, user_id % 7 AS stage, CAST(sum(CASE WHEN event_id % 4 > 0 AND user_id % 7 > 0 THEN event_id END) AS BIGINT) AS tokens, count(*) AS calls, count(*) FILTER (WHERE event_id % 4 = 0 OR user_id % 7 = 0) AS unknown FROM events GROUP BY ALL")
def usage_totals(s, d):
    e = table(s, d, "events").select("event_type", (F.col("user_id") % 7).alias("stage"), "event_id")
    return reports.usage_totals(e.withColumn("tokens", F.when((F.col("event_id") % 4 > 0) & (F.col("stage") > 0), F.col("event_id"))), ["event_type", "stage"], "tokens")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING l_orderkey % 3 = 0 AND (count(*) FILTER (WHERE l_returnflag = 'R') = 0 OR count(*) FILTER (WHERE l_returnflag <> 'R') = 0)")
def unreviewable_rows(s, d):
    status = F.when(F.col("l_orderkey") % 3 == 0, "needs_review").otherwise("ai_verified")
    return sided(s, d).where(reports.unreviewable(status, F.col("before"), F.col("after"))).select("l_orderkey")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def material_targets(s, d):
    flag = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), "Yes").when(F.col("o_orderstatus") == "O", "No")
    t = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", flag.alias("materiality"))).alias("results"))
    return reports.material_targets(t, "results", "materiality").select("o_custkey")


@query(f"WITH {SQL} SELECT match_id FROM changes WHERE (confidence_score IS NULL OR confidence_score < 0.5) AND NOT (match_id % 3 = 0 AND n_chars % 2 = 0)")
def verification_plan(s, d):
    c = changes(s, d).withColumn("source_hash", F.sha2("text", 256))
    ledger = c.where("match_id % 3 = 0").select("match_id", F.when(F.col("n_chars") % 2 == 0, F.col("source_hash")).otherwise("old").alias("source_hash"))
    return reports.verification_plan(c, ledger, ["match_id", "source_hash"], "confidence_score", 0.5).select("match_id")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_returnflag <> 'R') > 0 AND l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 1 AND count(DISTINCT l_partkey) = count(*) AND l_orderkey % 11 <> 0 AS supported FROM lineitem GROUP BY 1")
def supported_matches(s, d):
    k = F.col("l_orderkey")
    reasons = F.when(k % 5 == 0, F.array(F.lit("agent_did_not_finish"))).when(k % 7 == 2, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    status = F.when(k % 7 == 1, "needs_review").when(k % 7 == 2, "needs_review").otherwise("ai_verified")
    members = F.concat("before", "after")
    cited = F.when(k % 11 == 0, F.slice(members, 2, 100)).otherwise(members)
    return sided(s, d).select("l_orderkey", reports.supported(F.col("before"), F.col("after"), reasons, status, F.lit("why"), cited).alias("supported"))


@query(f"WITH {SQL}, r AS (SELECT match_id, match_id % 6 = 0 OR match_id % 5 = 1 AS review, status, change_type, match_id % 5 AS k FROM changes) SELECT match_id, review, NOT review AND status IN ('ai_verified', 'auto_matched', 'unmatched') AND k = 2 AND coalesce(change_type IN ('Added','Removed','Modified','Expanded','Reduced','Relocated','Reworded','Unchanged'), false) AS approved FROM r")
def review_states(s, d):
    c = changes(s, d)
    k = F.col("match_id")
    source = F.when(k % 6 == 0, "needs_review.json").otherwise("alignments.json")
    change = F.when(k % 5 == 1, "needs_review").when(k % 5 == 2, "completed")
    return c.select("match_id", reports.needs_change_review(source, change).alias("review"), reports.ai_approved_change(source, F.col("status"), change, F.col("change_type")).alias("approved"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'low' ELSE 'low,old' END AS reasons, CASE WHEN c_custkey % 4 = 0 THEN 'finalized' ELSE 'needs_review' END AS status FROM (SELECT c_custkey, c_custkey AS k FROM customer WHERE true) WHERE c_custkey % 4 < 2 UNION ALL SELECT c_custkey, 'low', 'needs_review' FROM customer WHERE c_custkey % 4 >= 2")
def kept_reasons(s, d):
    k = F.col("c_custkey") % 4
    reasons = F.when(k == 0, F.array(F.lit("old"), F.lit("older"))).when(k == 1, F.array(F.lit("low"))).otherwise(F.array(F.lit("low"), F.lit("old")))
    left, status = reports.kept_reasons(reasons, ["old", "older"])
    return table(s, d, "customer").select("c_custkey", F.array_join(left, ",").alias("reasons"), status.alias("status"))


@query("SELECT coalesce(c_custkey, s_suppkey) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE c_name END AS name, coalesce(s_nationkey, c_nationkey) AS nation FROM (SELECT * FROM customer WHERE c_custkey > 20) FULL JOIN supplier ON c_custkey = s_suppkey")
def overlaid_members(s, d):
    known = table(s, d, "customer").where("c_custkey > 20").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    told = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"))
    return reports.overlaid(known, told, "id", ["name", "nation"])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN 'fallback' ELSE 'Unclassified' END AS label, CASE WHEN turn % 2 = 0 AND trim(text) <> '' THEN trim(text) ELSE CASE WHEN role = 'b' THEN 'b' ELSE 'b ' || role END END AS text FROM conversations")
def normalised_records(s, d):
    c = table(s, d, "conversations")
    t = F.col("turn")
    label, text = reports.normalised_record(F.when(t % 3 == 0, F.col("role")).when(t % 3 == 1, " "), F.when(t % 3 == 1, "fallback"), F.when(t % 2 == 0, F.col("text")), F.array(F.lit(" b"), F.lit(""), F.lit("b "), F.col("role"), F.lit(None).cast("string")))
    return c.select("conv_id", "turn", label.alias("label"), text.alias("text"))


@query("SELECT DISTINCT 'alignments' AS kind, o_custkey AS company, CAST(year(o_orderdate) AS INT) AS year FROM orders UNION ALL SELECT DISTINCT 'disclosures', l_suppkey, CAST(year(l_shipdate) AS INT) FROM lineitem")
def known_scopes(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"))
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year"))
    return reports.known_scopes([("alignments", o), ("disclosures", li)], ["company", "year"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, CAST(year(l_shipdate) AS INT)) NOT IN (SELECT (o_custkey, CAST(year(o_orderdate) AS INT)) FROM orders)")
def missing_only(s, d):
    """The rows that an import of scopes that are not stored yet would add."""
    stored = table(s, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"))
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year"), "l_orderkey", "l_linenumber")
    return reports.missing_only(stored, rows, ["company", "year"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey AS scope, o_orderkey AS id, 'database' AS origin FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT l_suppkey, l_orderkey, 'files' FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)")
def preferred_source(s, d):
    db = table(s, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"))
    files = table(s, d, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_orderkey").alias("id"))
    return reports.preferred(db, files, ["scope"])


_EXPORT = "m AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'own' || l_linenumber END AS own FROM lineitem), p AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 5)"


@query(f"WITH {_EXPORT} SELECT l_orderkey, l_partkey, coalesce(own, p_brand) AS title, false AS missing FROM m LEFT JOIN p ON p_partkey = l_partkey UNION ALL SELECT l_orderkey, l_partkey, NULL, true FROM m WHERE l_partkey NOT IN (SELECT p_partkey FROM p)")
def alignment_export(s, d):
    """Rows with their members and details as an export has them, and the members that lack details."""
    li = lines(s, d)
    members = li.select("l_orderkey", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("own"), F.col("l_linenumber").cast("string"))).alias("title"))
    details = table(s, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("title"))
    rows, lost = reports.with_members(li.select("l_orderkey").distinct(), members, details, "l_orderkey", "l_partkey", ["title"])
    return reports.export_union([rows.withColumn("missing", F.lit(False)), lost.withColumn("missing", F.lit(True))])
