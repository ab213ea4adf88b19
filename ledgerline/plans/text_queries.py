"""Questions about texts: sentences, exact copies, differences, retrieval, labels. Documents are disclosures, their language
the item; an odd identifier stands for the newer year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import ladders
from ledgerline.functions import text as T
from ledgerline.operators import diff, pandas_text, retrieval
from ledgerline.plans.registry import registry
from ledgerline.sources import markup
from ledgerline.sources.tables import table

QUERIES, ORACLES, query = registry()
NEW = "doc_id % 2 = 1"
SQUEEZE = r"trim(regexp_replace({}, '[ \t\n\r\f\v]+', ' ', 'g'))"
FOLD = "translate({}, ' ‘’“”–—', ' ''''\"\"--')"


def docs(s, d, *more):
    return table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("item"), F.col("source").alias("section"), *more)


def is_new():
    return F.col("doc_id") % 2 == 1


@query(rf"SELECT doc_id, lower({SQUEEZE.format(FOLD.format('text'))}) AS key FROM documents")
def normalised_texts(s, d):
    return docs(s, d).select("doc_id", T.sentence_key(F.col("text")).alias("key"))


_KEYED = r"(SELECT doc_id, lang AS item, trim(regexp_replace(regexp_replace(text, '(^|\n)[^\S\n]*(?:[•◦▪‣⁃∙●][^\S\n]*|[-*][^\S\n]+([A-Za-z]))', '\1\2', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)"


@query(rf"SELECT item, sha256(t) AS text_sha256, min(doc_id) FILTER (WHERE NOT ({NEW})) AS previous_id, min(doc_id) FILTER (WHERE {NEW}) AS current_id FROM {_KEYED} WHERE t <> '' GROUP BY item, t HAVING count(*) FILTER (WHERE {NEW}) = 1 AND count(*) FILTER (WHERE NOT ({NEW})) = 1")
def exact_text_pairs(s, d):
    return diff.exact_pairs(docs(s, d), "item", "text", "doc_id", is_new())


_LINES = r"(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"


def lines(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)


@query(rf"WITH c AS (SELECT source, line, count(*) FILTER (WHERE NOT ({NEW})) AS o, count(*) FILTER (WHERE {NEW}) AS n FROM {_LINES} GROUP BY ALL) SELECT source, CAST(sum(least(o, n)) AS BIGINT) AS shared, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS old_only, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS new_only FROM c GROUP BY 1")
def line_diff_totals(s, d):
    return diff.diff_totals(lines(s, d), ["source"], "line", is_new())


@query(rf"WITH l AS (SELECT *, {NEW} AS new, row_number() OVER (PARTITION BY source, line, {NEW} ORDER BY doc_id, pos) AS r FROM {_LINES}), c AS (SELECT source, line, count(*) FILTER (WHERE NOT new) AS o, count(*) FILTER (WHERE new) AS n FROM l GROUP BY ALL) SELECT doc_id, CAST(pos AS INT) AS pos, source FROM l JOIN c USING (source, line) WHERE r > CASE WHEN new THEN o ELSE n END")
def surviving_lines(s, d):
    return diff.surviving(lines(s, d).select("doc_id", "pos", "source", "line"), ["source"], "line", ["doc_id", "pos"], is_new()).select("doc_id", "pos", "source")


@query("SELECT doc_id, CAST(len(w) AS INT) AS n_words, CAST(len(list_distinct(w)) AS INT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9]+') AS w FROM documents)")
def ascii_words(s, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9]+"), F.lit(0))
    return docs(s, d).select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"""words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda x: x NOT IN ({_STOP})) AS w FROM documents),
  pairs AS (SELECT doc_id, w, len(w) AS n FROM words),
  terms AS (SELECT doc_id, unnest(w) AS term FROM pairs UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, n)) AS i FROM pairs WHERE n > 1)),
  counts AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL)"""


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, sum(n)::BIGINT AS n FROM counts GROUP BY term")
def term_statistics(s, d):
    counts = retrieval.term_counts(docs(s, d), "doc_id", "text")
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


_VECTORS = f"""{_TERMS}, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY 1),
  raw AS (SELECT doc_id, term, (1 + ln(n)) * idf AS w FROM counts JOIN idf USING (term)), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1)"""


@query(f"WITH {_VECTORS} SELECT doc_id, count(*) AS n_terms, round(max(w / norm), 6) AS top, round(sum(w / norm), 4) AS total FROM raw JOIN norms USING (doc_id) GROUP BY 1")
def tfidf_vectors(s, d):
    v = retrieval.vectors(docs(s, d), "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum("weight"), 4).alias("total"))


def _sparse(s, d):
    """Benchmark items are the questions: each is scored against every document that shares a term."""
    every = docs(s, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text").unionByName(table(s, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("k"), "text"))
    v = retrieval.vectors(every, "k", "text")
    return retrieval.sparse_scores(v.where(F.col("k").startswith("q")), v.where(F.col("k").startswith("d")), "k", "k").withColumn("score", F.round("score", 6))


_ALL = _TERMS.replace("FROM documents", "FROM corpus").replace("doc_id", "k")
_SPARSE = f"""WITH corpus AS (SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark), {_ALL},
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY 1),
  raw AS (SELECT k, term, (1 + ln(n)) * idf AS w FROM counts JOIN idf USING (term)), norms AS (SELECT k, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
  v AS (SELECT k, term, w / norm AS w FROM raw JOIN norms USING (k)),
  scores AS (SELECT a.k AS q, b.k AS d, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b USING (term) WHERE a.k[1] = 'q' AND b.k[1] = 'd' GROUP BY 1, 2)"""


@query(_SPARSE + ", ahead AS (SELECT q, d, score, 'forward' AS direction FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM scores) WHERE r <= 5), back AS (SELECT q, d, score FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, q) AS r FROM scores WHERE score > 0) WHERE r <= 2) SELECT * FROM ahead UNION ALL SELECT q, d, score, 'reverse' FROM back ANTI JOIN ahead USING (q, d)")
def sparse_candidates(s, d):
    return retrieval.candidates(_sparse(s, d), 5, 2)


@query(_SPARSE + " SELECT DISTINCT ON (q) q, d, score, round(score / 0.65, 4) AS share FROM scores ORDER BY q, score DESC, d")
def best_candidate_share(s, d):
    return retrieval.best_share(_sparse(s, d), 0.65)


_DENSE = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), scores AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT q, d, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM scores) WHERE r <= 5"


@query(_DENSE)
def dense_candidates(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return retrieval.dense_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("q", "d", "score")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS squared FROM embeddings", name="vector_norms")
def _vector_norms(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("squared"))


_SPLIT = r"list_distinct(list_filter(regexp_split_to_array(coalesce({}, ''), '[ \t\n\r\f\v]+'), lambda x: x <> ''))"


@query(f"WITH p AS (SELECT a.conv_id, a.turn, {_SPLIT.format('a.text')} AS x, {_SPLIT.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE), 6) END AS overlap FROM p")
def word_overlap_of_turns(s, d):
    return turns(s, d).select("conv_id", "turn", F.round(T.word_overlap(F.col("old"), F.col("new")), 6).alias("overlap"))


def turns(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    return c.withColumnRenamed("text", "old").join(after, ["conv_id", "turn"])


@query()
def lexical_metrics_of_turns(s, d):
    m = turns(s, d).withColumn("m", pandas_text.text_metrics(F.col("old"), F.col("new")))
    return m.select("conv_id", "turn", "m.*", ladders.lexical_label(F.col("m.sequence_ratio"), F.lit(0.0), F.col("m.length_ratio")).alias("label"))


@query("SELECT conv_id, turn, CASE WHEN s >= 0.97 AND s >= 0.9 THEN 'Unchanged' WHEN s >= 0.7 AND old_role <> new_role THEN 'Relocated' WHEN s >= 0.97 THEN 'Unchanged' WHEN s >= 0.7 AND r >= 1.4 THEN 'Expanded' WHEN s >= 0.7 AND r <= 0.7 THEN 'Reduced' WHEN s >= 0.55 THEN 'Modified' ELSE 'Added' END AS label FROM (SELECT a.conv_id, a.turn, a.role AS old_role, b.role AS new_role, (length(a.text) % 100) / 100.0 AS s, CAST(length(b.text) AS DOUBLE) / nullif(length(a.text), 0) AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)")
def pair_labels(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    both = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("new_role"), F.col("n").alias("m")), ["conv_id", "turn"])
    score = (F.col("n") % 100) / 100
    return both.select("conv_id", "turn", ladders.pair_label(score, F.lit(1.0), score, F.col("role"), F.col("new_role"), F.col("n"), F.col("m")).alias("label"))


@query()
def document_sentences(s, d):
    return diff.sentence_rows(docs(s, d), ["doc_id", "item"], "text")


@query()
def packed_chunks(s, d):
    return docs(s, d).select("doc_id", F.posexplode(pandas_text.packed(F.col("text"), 1800, 120)).alias("chunk_index", "chunk"))


@query()
def greedy_turn_pairs(s, d):
    """Sentences of following turns, paired one to one by the overlap of their words, within a conversation."""
    c = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("conv"), "turn", "text")
    cut = diff.sentence_rows(c, ["conv", "turn"], "text").withColumn("id", F.col("turn") * (1 << 32) + F.col("position"))
    words = cut.select("conv", "turn", "id", F.explode(F.array_distinct(T.words(F.col("sentence")))).alias("w"), F.size(F.array_distinct(T.words(F.col("sentence")))).alias("n"))
    a, b = words.where("turn % 2 = 0"), words.where("turn % 2 = 1").select("conv", "w", F.col("turn").alias("turn2"), F.col("id").alias("id2"), F.col("n").alias("n2"))
    shared = a.join(b, ["conv", "w"]).where("turn2 = turn + 1").groupBy("conv", "id", "id2", "n", "n2").agg(F.count("*").alias("k"))
    scores = shared.withColumn("score", F.round(F.col("k") / (F.col("n") + F.col("n2") - F.col("k")), 6)).where("score >= 0.3")
    return pandas_text.greedy_pairs(scores, ["conv"], "id", "id2", "score")


@query()
def size_capped_batches(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return pandas_text.batches(c, "conv_id", "turn", "size", 4000)


@query("WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) SELECT conv_id, turn, round(s / (s + 1), 6) AS rank FROM (SELECT conv_id, turn, CAST(len(list_intersect(w, ['the', 'and', 'que'])) AS DOUBLE) AS s, list_has_all(w, ['the', 'and']) OR list_has_all(w, ['que']) AS hit FROM t) WHERE hit")
def topic_text_search(s, d):
    """OR of phrases, each of which needs all its words."""
    c = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    terms = c.select("k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"), F.lit(1.0).alias("weight"))
    return retrieval.text_search(terms, "k", [["the", "and"], ["que"]]).select("k.conv_id", "k.turn", "rank")


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(substr(text, 1, 100), '[ \t\n\r\f\v]+[^ \t\n\r\f\v]*$', '') END AS excerpt FROM documents")
def excerpts(s, d):
    return docs(s, d).select("doc_id", T.excerpt(F.col("text"), 100).alias("excerpt"))


@query()
def page_blocks(s, d):
    return markup.blocks(table(s, d, "pages"), "page_id", "html")


_GRID = "SELECT k, 0 AS r, 0 AS c, 'N' || k AS t FROM n UNION ALL SELECT k, 1, 0, 'N' || k FROM n UNION ALL SELECT k, 0, c, 'wide' FROM n, (SELECT unnest([1, 2]) AS c) UNION ALL SELECT k, 1, 1, CAST(o AS VARCHAR) FROM n UNION ALL SELECT k, 1, 2, 'x' FROM n"


@query(f"WITH n AS (SELECT n_nationkey AS k, n_regionkey AS o FROM nation) SELECT k, CAST(r AS INT) AS row, CAST(c AS INT) AS col, t AS text FROM ({_GRID})")
def page_grid(s, d):
    """The grid of a table with spans, one for each nation."""
    n = table(s, d, "nation")
    k = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit("<p>x</p><table><tr><th rowspan='2'>N"), k, F.lit("</th><td colspan=2>wide</td></tr><tr><td>"), F.col("n_regionkey").cast("string"), F.lit("<td>x</table>"))
    return markup.grids(n.select(F.col("n_nationkey").alias("k"), html.alias("html")), "k", "html").select("k", F.col("row_index").alias("row"), F.col("column_index").alias("col"), "text")
