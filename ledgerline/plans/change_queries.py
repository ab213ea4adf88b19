"""Questions about changes: every template of the question layer, as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import ladders
from ledgerline.operators import aggregates as A
from ledgerline.operators import diff, filters, graph, windows
from ledgerline.operators.filters import Filters
from ledgerline.plans.changes import SQL, changes
from ledgerline.plans.registry import registry
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()
W = f"WITH {SQL} "
ORDER = "materiality_score DESC NULLS LAST, confidence_score DESC NULLS LAST, match_id"
CARD = "company, previous_year, current_year, match_id, item, status, relationship, change_type, material, round(materiality_score, 4) AS materiality_score, round(confidence_score, 4) AS confidence_score, substr(text, 1, 600) AS excerpt"
RUN = "company, previous_year, current_year"
AVG = "floor(CAST(sum(CAST(materiality_score AS DECIMAL(28,10))) AS DOUBLE) * 1000.0 / nullif(count(materiality_score), 0) + 0.5) / 1000.0"


def _distribution(dims, sql_dims):
    outer = f"PARTITION BY {', '.join(sql_dims[:-1])}" if sql_dims[:-1] else ""
    select = ", ".join(f"coalesce({d}, 'Not analysed') AS {d}" for d in sql_dims)
    group = ", ".join(f"coalesce({d}, 'Not analysed')" for d in sql_dims)
    sql = W + f"SELECT *, CAST(round(n * 100.0 / sum(n) OVER ({outer}), 1) AS DOUBLE) AS pct FROM (SELECT {select}, count(*) AS n, count(*) FILTER (WHERE material = 'Yes') AS positive, {AVG} AS avg_score FROM changes GROUP BY {group})"
    return sql, lambda s, d: A.distribution(changes(s, d), dims, F.col("material") == "Yes", "materiality_score")


for _name, _dims in (("distribution_two_dims", ["company", "change_type"]), ("distribution_one_dim", ["change_type"]), ("distribution_item_status", ["item", "status"]), ("distribution_three_dims", ["item", "status", "change_type"])):
    _sql, _f = _distribution(_dims, _dims)
    query(_sql, _name)(_f)


@query(W + f"SELECT {RUN}, count(*) AS n FROM changes GROUP BY ALL")
def counts_by_run(s, d):
    return A.count_by(changes(s, d), *A.RUN)


@query(W + "SELECT item, count(*) AS n FROM changes WHERE change_type IS NOT NULL AND change_type <> 'Unchanged' GROUP BY item")
def changed_by_item(s, d):
    return A.count_by(changes(s, d).where(filters.changed_only()), "item")


@query(W + f"SELECT {CARD} FROM changes WHERE material = 'Yes' ORDER BY {ORDER} LIMIT 20")
def most_material_cards(s, d):
    return filters.cards(changes(s, d).where(filters.condition(Filters(material="Yes"))), filters.most_material(), filters.limit_of(Filters()))


@query(W + f"SELECT {CARD} FROM changes WHERE change_type IS DISTINCT FROM 'Unchanged' AND company IN ('src0', 'src3') AND previous_year >= 2020 AND current_year <= 2022 ORDER BY {ORDER} LIMIT 50")
def span_of_years_cards(s, d):
    f = Filters(companies=("src0", "src3"), previous_year=2020, current_year=2022, limit=500)
    return filters.cards(changes(s, d).where(filters.condition(f) & filters.not_unchanged()), filters.most_material(), filters.limit_of(f))


@query(W + f"SELECT {CARD} FROM changes WHERE confidence_score < 0.8 ORDER BY confidence_score, materiality_score DESC NULLS LAST, match_id LIMIT 12")
def lowest_confidence_cards(s, d):
    f = Filters(max_confidence=0.8, max_strict=True, limit=12)
    return filters.cards(changes(s, d).where(filters.condition(f)), [F.asc("confidence_score"), F.desc_nulls_last("materiality_score"), F.asc("match_id")], filters.limit_of(f))


@query(W + "SELECT match_id, company, item, previous_year FROM changes WHERE item IN ('en','de') AND change_type IN ('New','Removed','Modified') AND status IN ('ai_verified') AND relationship IN ('current_only','one_to_one') AND materiality_score > 0.5 AND previous_year = 2021 AND current_year = 2022")
def all_predicates(s, d):
    f = Filters(items=("en", "de"), change_types=("New", "Removed", "Modified"), statuses=("ai_verified",), relationships=("current_only", "one_to_one"), min_materiality=0.5, min_strict=True, previous_year=2021, current_year=2022)
    return changes(s, d).where(filters.condition(f)).select("match_id", "company", "item", "previous_year")


@query(W + "SELECT match_id, company, item, status FROM changes WHERE match_id IN (3, 14, 159, 2653)")
def match_detail(s, d):
    return changes(s, d).where(filters.condition(Filters(match_ids=(3, 14, 159, 2653)))).select("match_id", "company", "item", "status")


@query(W + f"""SELECT {RUN}, count(*) AS alignments, {', '.join(f"count(*) FILTER (WHERE change_type = '{t}') AS {t.lower()}" for t in A.TYPES)},
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE material = 'Yes') AS material_yes,
  CAST(round(100.0 * count(*) FILTER (WHERE change_type <> 'Unchanged') / nullif(count(change_type), 0), 1) AS DOUBLE) AS pct_changed, {AVG} AS avg_materiality FROM changes GROUP BY {RUN}""")
def change_profile_by_run(s, d):
    return A.profile(changes(s, d))


@query(W + f"SELECT {RUN}, item, count(*) AS n FROM changes WHERE material = 'Yes' GROUP BY ALL")
def material_by_run_and_item(s, d):
    return A.count_by(changes(s, d).where("material = 'Yes'"), *A.RUN, "item")


@query(W + f"SELECT company, previous_year, match_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company, previous_year ORDER BY {ORDER}) AS rank FROM changes WHERE material = 'Yes') WHERE rank <= 3")
def top_material_per_run(s, d):
    top = windows.top_per_group(changes(s, d).where("material = 'Yes'").select("company", "previous_year", "match_id", "materiality_score", "confidence_score"), ["company", "previous_year"], filters.most_material(), 3)
    return top.select("company", "previous_year", "match_id", "rank")


@query(W + "SELECT confidence_score, count(*) AS n, count(*) FILTER (WHERE material = 'Yes') AS material_yes FROM changes WHERE confidence_score IS NOT NULL GROUP BY 1")
def confidence_histogram(s, d):
    return A.confidence_histogram(changes(s, d))


@query(W + "SELECT semantic_label, lexical_label, change_type AS final_label, count(*) AS n FROM changes WHERE semantic_label <> lexical_label GROUP BY ALL")
def disagreement_matrix(s, d):
    return A.disagreement_matrix(changes(s, d))


@query(W + "SELECT count(*) FILTER (WHERE semantic_label = lexical_label) AS agree, count(*) FILTER (WHERE semantic_label <> lexical_label) AS disagree, count(*) AS compared FROM changes WHERE semantic_label IS NOT NULL AND lexical_label IS NOT NULL")
def agreement_rate(s, d):
    return A.agreement(changes(s, d))


@query(W + f"SELECT {RUN}, coalesce(change_type, 'Not analysed') AS change_type, count(*) AS n, count(*) FILTER (WHERE material = 'Yes') AS material_yes FROM changes GROUP BY ALL")
def change_types_by_run(s, d):
    return changes(s, d).groupBy(*A.RUN, F.coalesce("change_type", F.lit(A.NOT_ANALYSED)).alias("change_type")).agg(F.count("*").alias("n"), F.count_if(F.col("material") == "Yes").alias("material_yes"))


@query(W + "SELECT item, count(*) FILTER (WHERE change_type <> 'Unchanged') AS changed, count(*) FILTER (WHERE material = 'Yes') AS material_yes, count(*) AS total FROM changes GROUP BY item")
def changes_by_item(s, d):
    return A.changes_by_item(changes(s, d))


@query(W + "SELECT relationship, count(*) AS n FROM changes WHERE status = 'needs_review' AND relationship IN ('current_only','previous_only') GROUP BY 1")
def pending_one_sided(s, d):
    f = Filters(statuses=("needs_review",), relationships=("current_only", "previous_only"))
    return A.count_by(changes(s, d).where(filters.condition(f)), "relationship")


@query(W + "SELECT count(*) AS total, count(*) FILTER (WHERE change_type <> 'Unchanged') AS changed, count(*) FILTER (WHERE material = 'Yes') AS material, count(*) FILTER (WHERE status = 'needs_review') AS review FROM changes")
def home_kpis(s, d):
    return A.kpis(changes(s, d))


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(analysed, 0) AS analysed FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS analysed FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def run_overview(s, d):
    runs = table(s, d, "customer").select("c_custkey")
    own = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", 1).alias("material"))
    return A.overview(runs, own, ["c_custkey"])


@query(W + "SELECT match_id, CASE WHEN materiality_score IS NULL OR confidence_score IS NULL THEN NULL WHEN confidence_score < 0.6 THEN 'Uncertain' WHEN materiality_score >= 0.5 THEN 'Yes' ELSE 'No' END AS label FROM changes")
def materiality_labels(s, d):
    return changes(s, d).select("match_id", ladders.materiality_label(F.col("materiality_score"), F.col("confidence_score")).alias("label"))


@query(W + "SELECT match_id, CASE WHEN status = 'unmatched' AND relationship = 'current_only' THEN 'New' WHEN status = 'unmatched' AND relationship = 'previous_only' THEN 'Removed' WHEN status = 'auto_matched' THEN 'Unchanged' END AS label FROM changes")
def logical_labels(s, d):
    old = F.when(F.col("relationship") == "current_only", 0).otherwise(1)
    new = F.when(F.col("relationship") == "previous_only", 0).otherwise(1)
    return changes(s, d).select("match_id", ladders.logical_label(F.col("status"), old, new).alias("label"))


@query("SELECT l_orderkey, CASE WHEN p = 0 THEN 'current_only' WHEN c = 0 THEN 'previous_only' ELSE CASE WHEN p = 1 THEN 'one' ELSE 'many' END || '_to_' || CASE WHEN c = 1 THEN 'one' ELSE 'many' END END AS relationship FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'N') AS p, count(*) FILTER (WHERE l_returnflag = 'N') AS c FROM lineitem GROUP BY 1)")
def relationships(s, d):
    sides = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("p"), F.count_if(F.col("l_returnflag") == "N").alias("c"))
    return sides.select("l_orderkey", ladders.relationship(F.col("p"), F.col("c")).alias("relationship"))


@query(W + "SELECT company, match_id, n_chars, newest <> v AS superseded FROM (SELECT *, (n_chars, match_id) AS v, max((n_chars, match_id)) OVER (PARTITION BY company, item) AS newest FROM changes)")
def superseded_rows(s, d):
    rows = changes(s, d).select("company", "item", "match_id", "n_chars")
    return windows.latest(rows, ["company", "item"], ["n_chars", "match_id"]).select("company", "match_id", "n_chars", "superseded")


@query(W + "SELECT DISTINCT ON (company) company, match_id, n_chars FROM changes ORDER BY company, n_chars, match_id DESC")
def distinct_on_company(s, d):
    rows = changes(s, d).select("company", "match_id", "n_chars")
    return windows.first_per_group(rows, ["company"], [F.asc("n_chars"), F.desc("match_id")])


@query("WITH e AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(s, 6) DESC, user_id) AS rank FROM e) SELECT user_id, round(sum(1.0 / (60 + rank)), 9) AS fused, count(*) AS lists FROM r GROUP BY 1")
def rank_fusion(s, d):
    lists = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("score"))
    return windows.fuse_ranks(lists, "event_type", "user_id", "score")


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) SELECT a.year AS from_year, b.year AS to_year FROM y a JOIN y b ON b.year = a.year + 1")
def consecutive_years(s, d):
    return windows.consecutive(table(s, d, "orders").select(F.year("o_orderdate").alias("year")), "year")


@query("WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN event_id END AS page FROM events) SELECT event_id, first_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS page FROM e")
def page_back_fill(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("mark"))
    return windows.fill_back(e, ["user_id"], ["ts", "event_id"], "mark", "page").select("event_id", "page")


@query("WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' OR event_id % 5 = 0 THEN event_type || event_id END AS heading FROM events) SELECT event_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM e")
def heading_as_of(s, d):
    heading = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 5 == 0), F.concat("event_type", F.col("event_id").cast("string")))
    e = table(s, d, "events").select("event_id", "user_id", "ts", heading.alias("heading"))
    return windows.fill_forward(e, ["user_id"], ["ts", "event_id"], "heading", "title").select("event_id", "title")


@query("WITH e AS (SELECT *, lag(event_type) OVER w IS DISTINCT FROM event_type AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, run")
def continued_blocks(s, d):
    e = table(s, d, "events")
    before = F.lag("event_type").over(windows.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    marked = e.withColumn("starts", ~before.eqNullSafe(F.col("event_type")))
    runs = windows.islands(marked, ["user_id"], ["ts", "event_id"], F.col("starts"), "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH u AS (SELECT DISTINCT l_suppkey, CAST(l_partkey AS BIGINT) AS v FROM lineitem), i AS (SELECT *, v - row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS g FROM u), r AS (SELECT l_suppkey, count(*) AS run, min(v) AS first FROM i GROUP BY l_suppkey, g) SELECT DISTINCT ON (l_suppkey) l_suppkey, run AS longest, first FROM r ORDER BY l_suppkey, run DESC, first")
def longest_page_run(s, d):
    return windows.run_lengths(table(s, d, "lineitem").select("l_suppkey", F.col("l_partkey").cast("long").alias("v")), ["l_suppkey"], "v")


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_orderkey, o_orderpriority, r <= 5 AS in_quota FROM r ORDER BY r <= 5 DESC, o_totalprice DESC, o_orderkey LIMIT 40")
def quota_selection(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return windows.quota(rows, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, 40).select("o_orderkey", "o_orderpriority", "in_quota")


@query("SELECT event_id, user_id, before, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND before IS DISTINCT FROM event_type")
def change_points(s, d):
    return windows.change_points(table(s, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "before", "event_type")


@query("SELECT o_orderpriority, o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def totals_by_level(s, d):
    rows = table(s, d, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.lit(1).cast("long").alias("n"))
    out = A.grouped_sets(rows, ["o_orderpriority", "o_orderstatus"], ["total", "n"])
    return out.select("o_orderpriority", "o_orderstatus", "total", "n", "level")


@query("SELECT o_orderkey, coalesce(string_agg(l_linestatus || l_linenumber, ' | ' ORDER BY l_linenumber, l_linestatus) FILTER (WHERE l_quantity > 25), '') AS joined, count(*) FILTER (WHERE l_quantity > 25) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def ordered_text_per_alignment(s, d):
    # an order's lines number a handful
    rows = table(s, d, "orders").select(F.col("o_orderkey")).join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus", "l_quantity"), "o_orderkey")
    out = A.ordered_texts(rows.withColumn("t", F.concat("l_linestatus", F.col("l_linenumber").cast("string"))), "o_orderkey", "l_linenumber", "t", F.col("l_quantity") > 25)
    return out.withColumn("n", F.col("n").cast("long"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_orderkey + 1000000000 AS o FROM lineitem WHERE l_quantity > 49), c AS (SELECT s, o FROM e) SELECT count(*) AS nodes FROM (SELECT s FROM c UNION SELECT o FROM c)", name="component_nodes")
def _component_nodes(s, d):
    e = table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") + 1_000_000_000).alias("o"))
    return graph.components(e, "s", "o").agg(F.count("*").alias("nodes"))


@query()
def component_labels(s, d):
    """Over all edges; without SQL, as a recursive query over them is too slow."""
    e = table(s, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") + 1_000_000_000).alias("o"))
    return graph.components(e, "s", "o")


@query("WITH m AS (SELECT l_orderkey AS row, l_partkey AS member, l_returnflag <> 'A' AS ok FROM lineitem), o AS (SELECT member, count(DISTINCT row) AS owners, bool_and(ok) AS every FROM m GROUP BY 1) SELECT row, max(owners > 1 AND NOT every) AS conflict FROM m JOIN o USING (member) GROUP BY 1")
def assignment_conflicts(s, d):
    m = table(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("member"), (F.col("l_returnflag") != "A").alias("ok"))
    return graph.conflicts(m, "row", "member", "ok")


@query("SELECT l_orderkey, count(DISTINCT l_linestatus) AS sides FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) < 2")
def one_sided_rows(s, d):
    return graph.one_sided(table(s, d, "lineitem").select("l_orderkey", "l_linestatus"), "l_orderkey", "l_linestatus")


@query("WITH a AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '!' END AS n_name FROM nation WHERE n_nationkey > 8) SELECT n_nationkey FROM a LEFT JOIN b USING (n_nationkey) WHERE a.n_name IS DISTINCT FROM b.n_name")
def stale_copies(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    copy = n.where("n_nationkey > 8").withColumn("n_name", F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("!")))
    return diff.stale(n.where("n_nationkey < 15"), copy, ["n_nationkey"], "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = c_custkey)")
def orphan_rows(s, d):
    return diff.orphans(table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "lineitem").select(F.col("l_suppkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(s, d):
    return diff.repeated(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name || '*', c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def keyed_upsert(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return diff.upsert(c, new, ["c_custkey"])


@query("SELECT company, item, count(*) AS n FROM (SELECT source AS company, lang AS item, doc_id FROM documents UNION ALL SELECT role, 'chat', conv_id FROM conversations) GROUP BY ALL")
def union_of_partitions(s, d):
    a = table(s, d, "documents").select(F.col("source").alias("company"), F.col("lang").alias("item"), F.col("doc_id").alias("k"))
    b = table(s, d, "conversations").select(F.col("role").alias("company"), F.lit("chat").alias("item"), F.col("conv_id").alias("k"))
    return A.count_by(a.unionByName(b), "company", "item")


@query("SELECT conv_id, turn, (max(turn) OVER (PARTITION BY conv_id)) + 1 AS next_position FROM conversations")
def next_turn_position(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    return c.join(c.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_position")), "conv_id")
