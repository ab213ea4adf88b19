"""Questions about passages: context, sections, proposals, evidence, names. Turns of a conversation stand for sentences in
their order, events for blocks of a filing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import aggregates, passages
from ledgerline.plans.changes import SQL, changes
from ledgerline.plans.registry import registry
from ledgerline.sources import stores
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()


@query("SELECT conv_id, turn, CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(role) OVER w END AS before, CASE WHEN lead(turn) OVER w = turn + 1 THEN lead(role) OVER w END AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_context(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role")
    return passages.neighbours(c, "conv_id", "turn", "role").select("conv_id", "turn", "before", "after")


_EVENTS = "e AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_type, CAST(value * 100 AS BIGINT) AS size FROM events)"


@query(f"WITH {_EVENTS}, s AS (SELECT a.g, a.p AS start, min(b.p) AS stop FROM e a JOIN e b ON a.g = b.g AND b.p > a.p AND b.event_type = 'purchase' WHERE a.event_type = 'view' GROUP BY ALL), h AS (SELECT s.g, start, stop, CAST(coalesce(sum(size), 0) AS BIGINT) AS held FROM s LEFT JOIN e ON e.g = s.g AND e.p > start AND e.p < stop GROUP BY ALL) SELECT DISTINCT ON (g) g, start, stop AS \"end\", held FROM h WHERE held > 0 ORDER BY g, held DESC, start")
def longest_sections(s, d):
    e = table(s, d, "events")
    w = passages.Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("g"), F.row_number().over(w).alias("p"), "event_type", F.round(F.col("value") * 100).cast("long").alias("size"))
    out = passages.sections(rows, "g", "p", F.col("event_type") == "view", F.col("event_type") == "purchase", F.col("size"))
    return out.select("g", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "held")


@query("WITH c AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE turn <> 1), t AS (SELECT conv_id, turn, CASE WHEN b IS NULL THEN '' WHEN turn - b > 1 THEN ' [...] ' ELSE ' ' END || role AS t FROM c) SELECT conv_id, string_agg(t, '' ORDER BY turn) AS excerpt, CAST(count(*) AS INT) AS n FROM t GROUP BY 1")
def assembled_excerpts(s, d):
    c = table(s, d, "conversations").where("turn <> 1").select("conv_id", "turn", "role")
    return passages.assembled(c, "conv_id", "turn", "role")


_PROPOSALS = "p AS (SELECT l_orderkey AS proposal, l_partkey AS member FROM lineitem), allowed AS (SELECT p_partkey AS member FROM part UNION ALL SELECT p_partkey + 1000000 FROM part WHERE p_size = 7), u AS (SELECT member, count(*) AS uses FROM p GROUP BY 1)"


def _allowed(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("member")).union(p.where("p_size = 7").select(F.col("p_partkey") + 1000000))


def _proposals(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("proposal"), F.col("l_partkey").alias("member"))


@query(f"WITH {_PROPOSALS} SELECT proposal, CASE WHEN bool_or(a.member IS NULL) THEN 'unknown_member' WHEN bool_or(uses > 1) THEN 'member_used_twice' ELSE 'accepted' END AS status FROM p JOIN u USING (member) LEFT JOIN allowed a ON a.member = p.member GROUP BY 1")
def proposal_checks(s, d):
    return passages.checked_proposals(_proposals(s, d), _allowed(s, d), "proposal", "member")


@query(f"WITH {_PROPOSALS} SELECT member FROM allowed WHERE member NOT IN (SELECT member FROM p)")
def unassigned_members(s, d):
    return passages.unassigned(_allowed(s, d), _proposals(s, d), "member")


@query("WITH r AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), u AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto FROM r WHERE r <= 5) SELECT o_custkey, o_orderkey, size FROM u WHERE upto <= 400000")
def evidence_budget(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.round("o_totalprice").cast("long").alias("size"))
    return passages.evidence(o, "o_custkey", "o_orderkey", "o_totalprice", "size", 5, 400_000).select("o_custkey", "o_orderkey", "size")


@query("SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2")
def unordered_pairs(s, d):
    return passages.unordered_pairs(table(s, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal, max(CASE WHEN s_acctbal BETWEEN c_acctbal - 2000 AND c_acctbal + 2000 THEN c_custkey END) AS newest FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey GROUP BY ALL")
def newest_containing_run(s, d):
    rows = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_acctbal")
    runs = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_acctbal") - 2000).alias("low"), (F.col("c_acctbal") + 2000).alias("high"), "c_custkey")
    return passages.newest_within(rows, runs, "k", "low", "high", "s_acctbal", "c_custkey").withColumnRenamed("k", "s_nationkey")


@query("WITH w AS (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM part), x AS (SELECT *, len(list_distinct(string_split(n, ' '))) AS k, len(list_intersect(list_distinct(string_split(n, ' ')), ['large', 'ring'])) AS sh FROM w), r AS (SELECT p_partkey, p_name, round(CASE WHEN p_name = 'large ring' THEN 100.0 WHEN n = 'large ring' THEN 95.0 WHEN starts_with(n, 'large ring') THEN 92.0 WHEN sh = 2 THEN 55 + CAST(25.0 * sh AS DOUBLE) / k WHEN sh > 0 THEN CAST(35.0 * sh AS DOUBLE) / 2 END, 6) AS score FROM x) SELECT p_name, CAST(score AS DOUBLE) AS score FROM r WHERE score IS NOT NULL ORDER BY score DESC, p_name LIMIT 12")
def metric_name_search(s, d):
    return passages.ranked_matches(table(s, d, "part").select("p_name"), "p_name", "large ring", 12)


@query("SELECT DISTINCT ON (text) text, doc_id, lang FROM documents ORDER BY text, lang, doc_id")
def shared_blocks_once(s, d):
    return passages.first_of_shared(table(s, d, "documents").select("text", "lang", "doc_id"), ["text"], ["lang", "doc_id"])


@query("SELECT doc_id, field, sha256(t) AS text_sha256 FROM (SELECT doc_id, 'text' AS field, text AS t FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) WHERE t <> ''")
def field_hashes(s, d):
    return passages.unpivot_texts(table(s, d, "documents"), "doc_id", ["text", "lang", "source"])


@query(f"WITH {SQL} SELECT match_id, CASE WHEN starts_with(ltrim(t), '=') OR starts_with(ltrim(t), '+') OR starts_with(ltrim(t), '@') OR starts_with(ltrim(t), '-') THEN '''' || t ELSE t END AS cell, company, item FROM (SELECT *, regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS t FROM changes)")
def export_rows(s, d):
    from ledgerline.operators import filters

    return filters.export_rows(changes(s, d))


@query(f"WITH {SQL} SELECT match_id FROM changes WHERE contains(lower(concat_ws(' ', company, item, status, text)), 'the th') AND item IN ('en')")
def text_filter(s, d):
    from ledgerline.operators import filters

    return filters.search(changes(s, d), "The th", filters.Filters(items=("en",))).select("match_id")


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS parts FROM orders GROUP BY 1")
def nested_documents(s, d):
    """A customer's orders as one document, as a snapshot is rebuilt."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    whole = stores.nested(o, [(["o_custkey"], "parts", ["o_orderkey", "o_orderstatus"])])
    return whole.select("o_custkey", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["o_orderkey"], p["o_orderstatus"])), ",").alias("parts"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''’&.-]*'), lambda x: lower(x) NOT IN ('a','an','and','as','at','by','for','from','in','into','of','on','or','the','to','with')) AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE round(CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]|^.+[A-Z0-9]'))) AS DOUBLE) / len(w), 6) END AS share FROM w")
def title_shares(s, d):
    """How much a whole text looks like a title."""
    return table(s, d, "documents").select("doc_id", F.round(T.title_case_share(F.col("text")), 6).alias("share"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_path_counts(s, d):
    e = table(s, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return aggregates.count_by(e, "event_type", "k")


@query("SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def two_sided_groups(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value") - F.min("value"), 6).alias("spread"), F.count_distinct("event_type").alias("kinds")).where("kinds >= 2")


@query("SELECT DISTINCT p_brand, p_size FROM part INTERSECT SELECT p_brand, p_size FROM part WHERE p_retailprice > 950 EXCEPT SELECT p_brand, p_size FROM part WHERE p_size < 5")
def set_operations(s, d):
    p = table(s, d, "part")
    pick = lambda c: p.where(c).select("p_brand", "p_size")
    return pick("true").intersect(pick("p_retailprice > 950")).subtract(pick("p_size < 5"))


@query("SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) s WHERE n = (SELECT max(m) FROM (SELECT l_suppkey AS k, l_partkey, count(*) AS m FROM lineitem GROUP BY ALL) t WHERE t.k = s.l_suppkey)")
def most_frequent_members(s, d):
    n = table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("l_suppkey").agg(F.max("n").alias("n")), ["l_suppkey", "n"]).select("l_suppkey", "l_partkey", "n")
