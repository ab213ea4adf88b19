"""Questions about the extraction of filings: headings, references, footnotes, units. Texts are composed from keys, so that
SQL knows what must come out; a customer stands for a filing, an order for a table, a line for its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import units
from ledgerline.operators import extraction
from ledgerline.plans.registry import registry
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()


def text_of(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("SELECT c_custkey, CAST(1 AS INT) AS line, '1A' AS item, 'Risk Factors' AS title FROM customer UNION ALL SELECT c_custkey, 3, '7', 'Title ' || c_custkey FROM customer WHERE c_custkey % 2 = 0")
def item_headings(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, text_of("intro\nItem 1A. Risk Factors\nsee Item 7\nITEM 7 - Title ", k)).otherwise("intro\nItem 1A. Risk Factors\nItem 10. None\nitems of 7")
    return extraction.item_headings(c.select("c_custkey", text.alias("t")), "c_custkey", "t")


@query("WITH r AS (SELECT l_orderkey AS t, l_orderkey * 10 + l_linenumber AS id, l_linenumber * 1000000 + l_partkey AS r, CASE WHEN l_returnflag = 'A' THEN '7' WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN '1A' END AS own FROM lineitem), f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY t ORDER BY r, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM r) SELECT t, r, item FROM f WHERE item = '7'")
def table_references(s, d):
    li = table(s, d, "lineitem")
    text = F.when(F.col("l_returnflag") == "A", "See Item 7 here").when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 3), "item 1a").otherwise("page 3")
    rows = li.select(F.col("l_orderkey").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("r"), text.alias("x"))
    return extraction.table_references(rows.withColumn("o", F.struct("r", "id")), "t", "o", "x", ["7"]).select("t", "r", "item")


@query("WITH s AS (SELECT DISTINCT l_suppkey AS doc, (['1','1A','7','8'])[CAST(l_linenumber % 4 + 1 AS INT)] AS item, l_partkey % 100 AS block FROM lineitem) SELECT doc, item, block FROM s WHERE NOT (item = '1' AND EXISTS (SELECT 1 FROM s n WHERE n.doc = s.doc AND n.block = s.block AND n.item IN ('1A', '7', '8'))) AND NOT (item = '7' AND EXISTS (SELECT 1 FROM s n WHERE n.doc = s.doc AND n.block = s.block AND n.item = '8'))")
def without_broad_overlaps(s, d):
    item = F.get(F.array(*[F.lit(i) for i in ("1", "1A", "7", "8")]), F.col("l_linenumber") % 4)
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), item.alias("item"), (F.col("l_partkey") % 100).alias("block")).distinct()
    return extraction.without_broad_overlaps(rows, "doc", "item", ["block"]).select("doc", "item", "block")


@query("WITH t AS (SELECT c_nationkey AS doc, lower(c_mktsegment) || ' ' || c_custkey % 9 AS k, min(c_custkey) AS section, count(*) AS n FROM customer GROUP BY ALL) SELECT s_suppkey, section FROM supplier LEFT JOIN t ON doc = s_nationkey AND k = 'building ' || s_suppkey % 9 AND n = 1")
def followed_references(s, d):
    """References to another report's sections by title, numbers of notes aside."""
    c, r = table(s, d, "customer"), table(s, d, "supplier")
    sections = c.select(F.col("c_nationkey").alias("doc"), text_of("Note ", F.col("c_custkey") % 30, ". ", F.col("c_mktsegment"), " ", F.col("c_custkey") % 9).alias("title"), F.col("c_custkey").alias("section"))
    refs = r.select("s_suppkey", F.col("s_nationkey").alias("doc"), text_of("NOTE 7: Building  ", F.col("s_suppkey") % 9).alias("title"))
    return extraction.followed(refs, sections, "doc", "title").select("s_suppkey", "section")


@query("SELECT c_custkey, 0 AS pos, 'Cash [footnote 1: Restated for ' || c_custkey || '] and [footnote 2]' AS text FROM customer UNION ALL SELECT c_custkey, 2, 'Debt [footnote 1: Later note] ends' FROM customer UNION ALL SELECT c_custkey, 4, '3 A note that nobody asked for' FROM customer")
def inlined_footnotes(s, d):
    k = F.col("c_custkey")
    blocks = F.array(text_of("Cash [[FNREF:1]] and [[FNREF:2]]"), text_of("1 Restated for ", k), F.lit("Debt [[FNREF:1]] ends"), F.lit("1 Later note"), F.lit("3 A note that nobody asked for"))
    rows = table(s, d, "customer").select("c_custkey", F.posexplode(blocks).alias("pos", "text"))
    from ledgerline.functions import headings

    number, note = headings.footnote(F.col("text"))
    return extraction.inlined_footnotes(rows.withColumns({"note_no": number, "note": note}), "c_custkey", "pos", "text")


@query("SELECT o_custkey, o_orderkey, CAST(CASE WHEN o_orderkey % 1 = 0 THEN level END AS INT) AS level FROM (SELECT o_custkey, o_orderkey, CASE WHEN n = 1 OR x = lo THEN 1 ELSE 2 END AS level FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 2) * 18 AS x, row_number() OVER w AS n, min((o_orderkey % 2) * 18) OVER w AS lo FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)))")
def bullet_levels(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", ((F.col("o_orderkey") % 2) * 18.0).alias("indent"))
    return extraction.bullet_levels(o, "o_custkey", "o_orderkey", "indent").select("o_custkey", "o_orderkey", "level")


@query("SELECT s_suppkey, 'Sales rose. Then ' || s_name || ' www.Host.Com fell. We use a.io now' AS text FROM supplier")
def repaired_spaces(s, d):
    t = text_of("Sales rose.Then ", F.col("s_name"), " www.Host.Com fell.We use a.io now")
    return table(s, d, "supplier").select("s_suppkey", extraction.repaired_spaces(t).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'One  long-' || chr(10) || 'term plan.|Two.' WHEN c_custkey % 3 = 1 THEN 'All two. Two.' ELSE 'Exact one.' END AS sentences FROM customer")
def reconciled_sentences(s, d):
    k = F.col("c_custkey") % 3
    paragraph = F.when(k == 0, "One  long-\nterm plan. Two.").when(k == 1, "All two. Two.").otherwise("x Exact one. y")
    units_ = F.when(k == 0, F.array(F.lit("One long-term plan."), F.lit("Two."))).when(k == 1, F.array(F.lit("Not there"), F.lit("Two."))).otherwise(F.array(F.lit("Exact one.")))
    return table(s, d, "customer").select("c_custkey", F.array_join(extraction.reconciled(units_, paragraph), "|").alias("sentences"))


@query("WITH b AS (SELECT o_custkey, year(o_orderdate) AS b FROM orders GROUP BY ALL) SELECT x.o_custkey, CAST(x.b AS INT) AS \"left\", CAST(y.b AS INT) AS \"right\", CAST(row_number() OVER (PARTITION BY x.o_custkey ORDER BY x.b) AS INT) AS seam FROM b x JOIN b y ON x.o_custkey = y.o_custkey AND y.b = x.b + 1")
def batch_seams(s, d):
    b = table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("b")).distinct()
    return extraction.seams(b, "b", ["o_custkey"])


_SEAM = "SELECT g, p, '{0}' AS side FROM (SELECT g, p, row_number() OVER w AS r, sum(n) OVER w AS upto FROM (SELECT l_orderkey AS g, l_partkey AS p, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY g ORDER BY p {1} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE r <= 3 AND upto <= 60"


@query(f"{_SEAM.format('before', 'DESC')} UNION ALL {_SEAM.format('after', 'ASC')}")
def seam_context(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("p")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return extraction.seam_context(li, "g", "p", "n", 3, 60)


@query("WITH g AS (SELECT l_partkey AS c, l_orderkey AS g, l_orderkey % 3 > 0 AS ok FROM lineitem WHERE l_quantity < 3), k AS (SELECT p_partkey AS c FROM part WHERE p_size <> 4), t AS (SELECT c, count(*) AS n FROM g GROUP BY 1) SELECT CAST(coalesce(k.c, t.c) AS VARCHAR) AS id, CASE WHEN k.c IS NULL THEN 'unknown' WHEN n IS NULL THEN 'omitted' ELSE 'repeated' END AS problem FROM k FULL JOIN t ON k.c = t.c WHERE k.c IS NULL OR n IS NULL OR n > 1 UNION ALL SELECT CAST(g AS VARCHAR), 'unresolved' FROM g GROUP BY g HAVING count(*) > 1 AND NOT bool_and(ok)")
def exact_covers(s, d):
    g = table(s, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("c"), F.col("l_orderkey").alias("g"), (F.col("l_orderkey") % 3 > 0).alias("ok"))
    return extraction.exact_cover(g, table(s, d, "part").where("p_size <> 4").select(F.col("p_partkey").alias("c")), "c", "g", "ok")


@query("SELECT l_orderkey, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS units, count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_partkey) = count(*) AS valid, count(*) AS n FROM lineitem GROUP BY 1")
def merged_candidates(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_returnflag", F.array(F.col("l_partkey").cast("string")).alias("u"), "l_linenumber")
    return extraction.merged_candidates(li, "l_orderkey", "l_returnflag", "u", "l_linenumber").select("l_orderkey", F.array_join("units", ",").alias("units"), "valid", "n")


_RELOCATED = """WITH r AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS item, c_mktsegment AS title, c_custkey AS position, 'x ' || c_custkey % 50 || ' y' AS t FROM customer),
  n AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS item, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'none' END AS title, 'x ' || s_suppkey % 50 || ' y' AS t, s_suppkey AS old_id FROM supplier),
  h AS (SELECT n.*, EXISTS (SELECT 1 FROM r WHERE r.item = n.item AND r.title = n.title) AS ht FROM n),
  m AS (SELECT k, old_id, count(*) AS matches, bool_or(id = old_id) AS same, min(position) AS first FROM h JOIN r ON r.item = h.item AND (NOT ht OR r.title = h.title) AND r.t = h.t GROUP BY ALL)
SELECT n.k, CASE WHEN matches IS NULL OR same THEN n.old_id ELSE first END AS id, CASE WHEN matches IS NULL THEN 'no_match' WHEN matches = 1 THEN 'exact_text_match' WHEN same THEN 'multiple_matches_kept_same_id' ELSE 'multiple_matches_used_first' END AS status, coalesce(matches, 0) AS matches FROM n LEFT JOIN m USING (k)"""


@query(_RELOCATED)
def relocated_notes(s, d):
    c, p = table(s, d, "customer"), table(s, d, "supplier")
    records = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("item"), F.col("c_mktsegment").alias("title"), F.col("c_custkey").alias("position"), text_of("x ", F.col("c_custkey") % 50, " y").alias("text"))
    notes = p.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("string").alias("item"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("none").alias("title"), text_of("X  ", F.col("s_suppkey") % 50, " Y").alias("text"), F.col("s_suppkey").alias("old_id"))
    return extraction.relocated(notes, records, "k")


@query("WITH o AS (SELECT o_custkey AS doc, o_orderkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT doc, max(CASE WHEN r = 1 THEN p END) AS first, max(CASE WHEN r = 2 THEN p END) AS last, CAST(2 AS BIGINT) AS records FROM o GROUP BY 1 HAVING count(*) >= 2")
def spanning_matches(s, d):
    """Passages over the end of a customer's first order and the beginning of the second."""
    w = extraction.Window.partitionBy("doc").orderBy("p")
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("p")).withColumn("r", F.row_number().over(w))
    rows = o.withColumn("t", F.when(F.col("r") == 1, "one  two").when(F.col("r") == 2, "Three four").otherwise("other"))
    return extraction.spanning_match(rows, "doc", "p", "t", F.lit("two three"))


@query("WITH n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN [] WHEN s_suppkey % 4 = 1 THEN [s_suppkey] ELSE [s_suppkey, s_suppkey + 1000000] END AS ids FROM supplier), f AS (SELECT k, len(ids) AS asked, count(c_custkey) AS found, string_agg(c_name, chr(10) ORDER BY c_custkey) AS context FROM n LEFT JOIN customer ON list_contains(ids, c_custkey) GROUP BY ALL) SELECT k, coalesce(context, '') AS context, CASE WHEN asked = 0 THEN 'no_id' WHEN found = 0 THEN 'id_not_found' WHEN found < asked THEN 'single_chunk_partial' ELSE 'single_chunk' END AS status FROM f")
def paragraph_contexts(s, d):
    k = F.col("s_suppkey")
    ids = F.when(k % 4 == 0, "none").when(k % 4 == 1, text_of("P", k)).otherwise(text_of("P", k, " - P", k + 1000000, "; P", k))
    notes = table(s, d, "supplier").select(k.alias("k"), ids.alias("ids"))
    records = table(s, d, "customer").select(text_of("P", F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("text"))
    out = extraction.paragraph_context(notes, records, "k", "ids")
    return out.select("k", F.coalesce("context", F.lit("")).alias("context"), "status")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'dash' WHEN 5 THEN NULL ELSE 'number' END AS kind, CAST(CASE c_custkey % 6 WHEN 1 THEN -c_custkey WHEN 2 THEN c_custkey + 0.5 WHEN 3 THEN c_custkey WHEN 4 THEN c_custkey * 1000 END AS DOUBLE) AS number, CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 6 = 2 END AS percent, CASE c_custkey % 6 WHEN 0 THEN 'dash' WHEN 5 THEN NULL ELSE CASE WHEN c_custkey % 6 = 3 AND c_custkey BETWEEN 1900 AND 2199 THEN 'year' ELSE 'amount' END END AS measure FROM customer")
def displayed_amounts(s, d):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, " — ").when(k % 6 == 1, text_of("$ (", k, ") (a)")).when(k % 6 == 2, text_of(k, ".5 %")).when(k % 6 == 3, text_of(k, "*")).when(k % 6 == 4, text_of("USD ", F.format_number(k * 1000, 0))).otherwise("about 5 units")
    return table(s, d, "customer").select("c_custkey", units.amount(text).alias("a"), units.measure(text).alias("measure")).select("c_custkey", "a.kind", F.col("a.number").cast("double").alias("number"), "a.percent", "measure")


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR/shares' WHEN 2 THEN 'pure' WHEN 3 THEN NULL ELSE 'GBP' END AS unit, CASE n_nationkey % 5 WHEN 0 THEN 6 WHEN 2 THEN -2 WHEN 4 THEN 0 ELSE 0 END AS power, CASE n_nationkey % 5 WHEN 3 THEN 'missing_or_ambiguous_unit' WHEN 4 THEN 'conflicting_display_scales' ELSE '' END AS issues, CAST(CASE n_nationkey % 5 WHEN 0 THEN n_nationkey * 1000000 WHEN 2 THEN n_nationkey / 100.0 ELSE n_nationkey END AS DOUBLE) AS value FROM nation")
def units_and_scales(s, d):
    k = F.col("n_nationkey")
    evidence = F.when(k % 5 == 0, F.array(F.lit("$ in millions"))).when(k % 5 == 1, F.array(F.lit("€"), F.lit("in thousands"))).when(k % 5 == 2, F.array(F.lit("change %"))).when(k % 5 == 3, F.array(F.lit("number of stores"))).otherwise(F.array(F.lit("GBP thousands"), F.lit("billions")))
    label = F.when(k % 5 == 1, "Earnings per share").otherwise("Sales")
    u = units.unit_and_scale(F.lit(False), label, evidence, F.array(F.lit("USD"), F.lit("EUR")))
    out = table(s, d, "nation").select("n_nationkey", u.alias("u"))
    return out.select("n_nationkey", "u.unit", "u.power", F.array_join("u.issues", ",").alias("issues"), units.scaled(F.col("n_nationkey"), F.col("u.power")).cast("double").alias("value"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '2024-01-01' END AS start, CASE n_nationkey % 4 WHEN 0 THEN '2024-12-31' WHEN 1 THEN '2023-06-30' WHEN 2 THEN '2024-12-31' END AS \"end\", CASE n_nationkey % 4 WHEN 0 THEN 'duration' WHEN 1 THEN 'duration' WHEN 2 THEN 'instant' END AS kind, CASE n_nationkey % 4 WHEN 1 THEN 'unverified_period_start' WHEN 3 THEN 'missing_or_ambiguous_period' END AS issue FROM nation")
def column_periods(s, d):
    k = F.col("n_nationkey") % 4
    headers = F.when(k == 0, F.array(F.lit("Year ended"), F.lit("December 31, 2024"))).when(k == 1, F.array(F.lit("Three months ended June 30"))).when(k == 2, F.array(F.lit("2024"))).otherwise(F.array(F.lit("2022 and 2023")))
    dates = F.when(k == 0, F.array(F.lit("2024-12-31"))).when(k == 1, F.array(F.lit("2023-06-30"))).otherwise(F.array().cast("array<string>"))
    calendar = F.create_map(F.lit("2024-12-31"), F.array(F.lit("2024-01-01")), F.lit("2022-12-31"), F.array(F.lit("2022-01-01")), F.lit("2023-12-31"), F.array(F.lit("2023-01-01")))
    return table(s, d, "nation").select("n_nationkey", units.period_of(headers, dates, calendar).alias("p")).select("n_nationkey", "p.*")


@query("SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN c_custkey * 1000 WHEN 1 THEN -(c_custkey + 0.5) WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE c_custkey END AS DOUBLE) AS number, CASE WHEN c_custkey % 6 < 4 THEN make_date(2000 + c_custkey % 6, 1 + c_custkey % 12, 1 + c_custkey % 28) END AS day FROM customer")
def inline_values(s, d):
    """Tagged numbers and dates by their transformations; wrong ones are null."""
    k = F.col("c_custkey")
    m = k % 6
    raw = F.when(m == 0, F.format_number(k, 0)).when(m == 1, text_of(k, ",5")).when(m == 2, "any").when(m == 3, "—").when(m == 4, "1.2.3").otherwise(k.cast("string"))
    form = F.when(m == 0, "num-dot-decimal").when(m == 1, "num-comma-decimal").when(m == 2, "fixed-zero").when(m == 3, "zerodash").when(m == 4, "num-dot-decimal")
    number = units.inline_number(raw, form, F.when(m == 0, 3).otherwise(0), F.when(m == 1, "-"))
    y, mo, da = F.lit(2000) + m, F.lit(1) + k % 12, F.lit(1) + k % 28
    day = F.make_date(y.cast("int"), mo.cast("int"), da.cast("int"))
    text = F.when(m == 0, F.date_format(day, "M/d/yyyy")).when(m == 1, F.date_format(day, "d. M. yyyy")).when(m == 2, F.date_format(day, "yyyy-MM-dd")).when(m == 3, F.date_format(day, "MMMM d, yyyy")).when(m == 4, "13/45/2001").otherwise("soon")
    order = F.when(m == 0, "mdy").when(m == 1, "dmy").when(m == 2, "ymd").when(m == 3, "en").otherwise("mdy")
    return table(s, d, "customer").select("c_custkey", number.cast("double").alias("number"), units.inline_date(text, order).alias("day"))


@query("WITH t AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS y, count(*) FILTER (WHERE o_orderkey % 4 > 1) AS w FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN a >= 2 AND CAST(a AS DOUBLE) / greatest(a + w, 1) >= 0.4 THEN 'financial' WHEN CAST(a AS DOUBLE) / greatest(a + w, 1) < 0.1 THEN 'narrative' ELSE 'review' END AS kind FROM t")
def table_kinds(s, d):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.format_number("o_totalprice", 2)).when(k == 1, "2024").otherwise("words only")
    what = units.measure(cell)
    t = table(s, d, "orders").select("o_custkey", what.alias("m")).groupBy("o_custkey").agg(F.count_if(F.col("m") == "amount").alias("a"), F.count_if(F.col("m") == "year").alias("y"), F.count_if(F.col("m").isNull()).alias("w"))
    return t.select("o_custkey", units.table_kind(F.col("a"), F.col("a"), F.col("y"), F.col("w")).alias("kind"))


_OUTLINE = "h AS (SELECT user_id AS doc, event_id AS pos, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS level FROM events), o AS (SELECT a.doc, a.pos, a.level, min(b.pos) AS \"end\" FROM h a LEFT JOIN h b ON a.doc = b.doc AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL)"


def _headings(s, d):
    t = F.col("event_type")
    e = table(s, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.when(t == "purchase", 1).when(t == "view", 2).otherwise(3).alias("level"))
    return e.withColumn("title", text_of("Note ", F.col("pos"), ". Part ", F.col("pos") % 50))


@query(f"WITH {_OUTLINE} SELECT * FROM o")
def outlines(s, d):
    return extraction.outline(_headings(s, d), "doc", "pos", "level", "title").drop("title")


@query(f"WITH {_OUTLINE}, i AS (SELECT DISTINCT user_id AS doc, (['1', '7'])[CAST(event_id % 2 + 1 AS INT)] AS item, event_id % 50 AS t FROM events WHERE event_id % 40 IN (3, 8)) SELECT DISTINCT h.doc, item, h.pos FROM i JOIN o ON o.doc = i.doc AND o.pos % 50 = i.t JOIN h ON h.doc = o.doc AND h.pos >= o.pos AND (o.\"end\" IS NULL OR h.pos < o.\"end\") WHERE h.pos % 7 <> 2 OR item = '7'")
def indexed_sections(s, d):
    """Blocks of items by an index of titles, on the pages that it allows."""
    h = _headings(s, d)
    index = h.where("pos % 40 in (3, 8)").select("doc", F.when(F.col("pos") % 2 == 0, "1").otherwise("7").alias("item"), text_of("Part ", F.col("pos") % 50).alias("title")).distinct()
    pages = index.select("doc", "item").distinct().withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(6)))).where("page <> 2 or item = '7'")
    blocks = h.select("doc", "pos", (F.col("pos") % 7).cast("int").alias("page"), F.lit("t").alias("text"))
    return extraction.indexed_sections(index, extraction.outline(h, "doc", "pos", "level", "title"), blocks, "doc", "pos", "title", pages).select("doc", "item", "pos")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 WHEN s_suppkey % 3 = 1 THEN false ELSE true END AS closes FROM supplier")
def heading_closes(s, d):
    k = F.col("s_suppkey")
    size = F.when(k % 3 == 0, 12.0).when(k % 3 == 1, 10.0).otherwise(14.0)
    style = F.when(k % 2 == 0, "bold").otherwise("italic")
    no = F.lit(False)
    return table(s, d, "supplier").select("s_suppkey", extraction.closes(size, style, no, F.lit(12.0), F.lit("bold"), no).alias("closes"))


@query("SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS index, 'acme_2024_' || o_orderstatus || '_P' || printf('%03d', row_number() OVER w) AS id FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)")
def block_records(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return extraction.records(o, "o_custkey", "o_orderstatus", "o_orderkey", F.lit(2024), F.lit("Acme")).select("o_orderkey", "index", "id")


@query("SELECT s_suppkey, s_suppkey || '_S' || lpad(CAST(i AS VARCHAR), 2, '0') AS sentence_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'One ' || i || '.' END AS sentence FROM supplier, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= greatest(s_suppkey % 4, 1)")
def sentence_records(s, d):
    from ledgerline.functions import text as T

    k = F.col("s_suppkey")
    body = F.when(k % 4 == 0, "").when(k % 4 == 1, "One 1.").when(k % 4 == 2, "One 1. One 2.").otherwise("One 1.\nOne 2. One 3.")
    return extraction.sentence_records(table(s, d, "supplier").select("s_suppkey", body.alias("t")), "s_suppkey", T.sentences(F.col("t")))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Modified' WHEN 1 THEN 'Added' WHEN 2 THEN 'Removed' WHEN 3 THEN 'Reworded' END AS label, CASE c_custkey % 5 WHEN 0 THEN 'why' WHEN 1 THEN 'so' END AS reason, CASE c_custkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' WHEN 2 THEN 'lexical' END AS method FROM customer")
def compacted_analyses(s, d):
    k = F.col("c_custkey") % 5
    json = F.when(k == 0, '{"label":"Modified","reason":"why","method":"manual"}').when(k == 1, '{"llm":{"label":"Added","reason":"so"}}').when(k == 2, '{"lexical":"Removed"}').when(k == 3, "Reworded").otherwise("{}")
    return table(s, d, "customer").select("c_custkey", extraction.compacted(json).alias("a")).select("c_custkey", "a.*")


@query("SELECT s_suppkey AS k, 'old ' || s_suppkey AS previous_context, 'single_chunk' AS previous_status, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_suppkey ELSE '' END AS current_context, CASE WHEN s_suppkey % 2 = 0 THEN 'single_chunk' ELSE 'id_not_found' END AS current_status FROM supplier")
def enriched_notes(s, d):
    p = table(s, d, "supplier")
    k = F.col("s_suppkey")
    notes = p.select(k.alias("k"), text_of("P", k).alias("a"), text_of("P", k, " ").alias("b"))
    of = lambda rows, side, word: rows.select(text_of("P", k).alias("id"), k.alias("position"), text_of(word, k).alias("text"), F.lit(side).alias("side"))
    records = of(p, "previous", "old ").union(of(p.where("s_suppkey % 2 = 0"), "current", "new "))
    out = extraction.enriched(notes, records, "k", {"previous": "a", "current": "b"}).drop("a", "b")
    return out.withColumn("current_context", F.coalesce("current_context", F.lit("")))
