"""Operators on small tables: what they mean where the large tables do not show it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import ladders, numbers
from ledgerline.functions import text as X
from ledgerline.operators import diff, extraction, facts, filters, graph, pandas_text, retrieval, windows
from ledgerline.plans import catalog, questions
from ledgerline.plans.changes import changes
from ledgerline.sources import markup, stores
from ledgerline.streaming import feeds


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_sentences(spark):
    text = "The U.S. unit grew. It was  “good”! • first thing • Second J. Smith spoke? (Yes) see No. 5 there"
    assert one(spark, X.sentences(F.col("t")), t=text) == ["The U.S. unit grew.", 'It was "good"!', "• first thing", "• Second J. Smith spoke?", "(Yes) see No. 5 there"]
    assert one(spark, X.sentences(F.col("t")), t=None) == []


def test_full_text_key(spark):
    assert one(spark, X.full_text_key(F.col("t")), t="  • One\n - two 3-4\n-5 left\n* 7") == "One two 3-4 -5 left * 7"


def test_terms(spark):
    assert one(spark, X.terms(F.col("t")), t="The big Risk of big loss a1") == ["big", "risk", "big", "loss", "a1", "big risk", "risk big", "big loss", "loss a1"]
    assert one(spark, X.terms(F.col("t")), t="the") == [] and one(spark, X.terms(F.col("t")), t="risk") == ["risk"]


@pytest.mark.parametrize("raw,kind,number", [("", "blank", None), (None, "blank", None), (" — ", "dash", None), ("$ (1,234.50)", "number", "-1234.500000"), ("12 %", "number", "12.000000"), ("−3", "number", "-3.000000"), ("1,23", "text", None), ("n/a", "text", None), (".5", "number", "0.500000")])
def test_cells(spark, raw, kind, number):
    k, n = numbers.cell_kind_and_number(F.col("t"))
    row = spark.createDataFrame([(raw,)], "t string").select(k.alias("k"), n.alias("n")).first()
    assert (row.k, None if row.n is None else str(row.n)) == (kind, number)


def test_ladders(spark):
    rows = spark.createDataFrame([(0.98, 0.95, "a", "b", 10, 10), (0.98, 0.5, "a", "b", 10, 10), (0.98, 0.5, "a", "a", 10, 10), (0.8, 0.5, "a", "a", 10, 14), (0.8, 0.5, "", "a", 10, 7), (0.6, 0.1, "a", "b", 1, 9), (0.5, 1.0, "a", "a", 1, 1), (None, 1.0, "a", "a", 1, 1)], "s double, o double, a string, b string, n int, m int")
    label = ladders.pair_label(F.col("s"), F.lit(1.0), F.col("o"), F.col("a"), F.col("b"), F.col("n"), F.col("m"))
    assert [r.x for r in rows.select(label.alias("x")).collect()] == ["Unchanged", "Relocated", "Unchanged", "Expanded", "Reduced", "Modified", "Added", "Added"]
    assert one(spark, ladders.truth(F.col("t")), t=" Material ") is True and one(spark, ladders.truth(F.col("t")), t="perhaps") is None


def test_surviving_cancels_first_occurrences(spark):
    rows = spark.createDataFrame([("g", "x", 1, False), ("g", "x", 2, False), ("g", "x", 3, False), ("g", "x", 4, True), ("g", "y", 5, True)], "g string, k string, p int, new boolean")
    left = diff.surviving(rows, ["g"], "k", ["p"], F.col("new"))
    assert sorted(r.p for r in left.collect()) == [2, 3, 5]
    totals = diff.diff_totals(rows, ["g"], "k", F.col("new")).first()
    assert (totals.shared, totals.old_only, totals.new_only) == (1, 2, 1)


def test_exact_pairs_need_uniqueness(spark):
    rows = spark.createDataFrame([(1, "i", "A b", False), (2, "i", "• A  b", True), (3, "i", "c", False), (4, "i", "c", True), (5, "i", "c", True), (6, "j", "A b", True), (7, "i", "", False), (8, "i", "", True)], "k long, item string, t string, new boolean")
    assert [(r.previous_id, r.current_id) for r in diff.exact_pairs(rows, "item", "t", "k", F.col("new")).collect()] == [(1, 2)]


def test_growth_rules(spark):
    rows = spark.createDataFrame([("a", 2020, 100.0), ("a", 2021, 90.0), ("a", 2023, 50.0), ("b", 2020, 0.0), ("b", 2021, 5.0), ("c", 2020, 1.0), ("c", 2020, 2.0), ("c", 2021, 3.0), ("d", 2020, -8.0), ("d", 2021, 4.0)], "k string, y int, v double")
    got = {(r.k, r.to_year): float(r.growth_pct) for r in facts.growth(rows.withColumn("v", F.col("v").cast("decimal(18,2)")), ["k"], "y", "v").collect()}
    assert got == {("a", 2021): -10.0, ("d", 2021): 150.0}


def test_conflicting_versions(spark):
    rows = spark.createDataFrame([("c", 1, 5), ("c", 2, 7), ("c", 2, 8), ("e", 1, 3), ("e", 3, 4), ("e", 3, 4)], "k string, v int, a int")
    assert {r.k: (r.status, r.amount) for r in facts.resolved(rows, ["k"], "v", "a").collect()} == {"c": ("ambiguous", None), "e": ("found", 4)}
    assert {r.k: r.amounts for r in facts.latest_values(rows, ["k"], "v", "a").collect()} == {"c": [7, 8], "e": [4]}


def test_components(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)] + [(7, None), (300, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(root)}


def test_components_keep_no_plans(spark, tmp_path):
    """A round is a table: what comes out is read from one, not from frames that know the plans of the rounds before."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    out = graph.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"), "a", "b")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan
    assert len(list(tmp_path.glob("*/stored-*"))) == 1  # tables of earlier rounds and edges are deleted
    assert {r.component for r in out.collect()} == {0}


def test_row_labels_pair_within_rows(spark, tmp_path):
    """Against its SQL, lines without a flag too; one kind has so many parts that its hits must not be listed."""
    import duckdb

    n = 300
    parts = [(i, "b", "t", 1) for i in range(n)] + [(n, None, "t", 1), (n + 1, None, "t", 1), (n + 2, "c", "t", 2)]
    rng = random.Random(3)
    lines = [(rng.randrange(n + 3), rng.randrange(40), rng.choice(["R", "A", "N", None])) for _ in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    frame = catalog.QUERIES["row_labels"](spark, str(tmp_path))
    want = con.execute(f"SELECT r, n_previous, n_current, label, direction, score FROM ({catalog.ORACLES['row_labels']})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def test_table_references_of_ties(spark):
    rows = [(1, 1, "See Item 7 here"), (1, 1, "page 3"), (1, 1, "item 1a"), (1, 2, "page 4"), (2, 1, "page 3"), (2, 1, "Item 7")]
    results = {tuple(sorted(map(tuple, extraction.table_references(spark.createDataFrame(order, "t int, o int, x string").coalesce(1), "t", "o", "x", ["7"]).collect()))) for order in (rows, rows[::-1])}
    assert results == {((1, 1, "See Item 7 here", "7"), (1, 2, "page 4", "7"), (2, 1, "Item 7", "7"))}


def test_consolidation(spark):
    members = spark.createDataFrame([(1, 10, "previous", True), (1, 20, "current", True), (2, 10, "previous", True), (2, 21, "current", True), (3, 11, "previous", True), (3, 22, "current", True)], "row long, member long, side string, ok boolean")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    got = {r.component: (r.rows, r.n_previous, r.n_current, r.merged) for r in graph.consolidated(members, labels, "row", "member", "side", "ok").collect()}
    assert got == {1: (2, 1, 2, True), 3: (1, 1, 1, False)}


def test_candidates_backward(spark):
    scores = spark.createDataFrame([("q1", "d1", 0.9), ("q1", "d2", 0.8), ("q2", "d2", 0.7), ("q2", "d3", 0.0)], "q string, d string, score double")
    got = {(r.q, r.d, r.direction) for r in retrieval.candidates(scores, 1, 2).collect()}
    assert got == {("q1", "d1", "forward"), ("q2", "d2", "forward"), ("q1", "d2", "reverse")}


def test_windows(spark):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([None, 4, None, 6, None])], "g string, i int, v int")
    assert [r.p for r in windows.fill_back(rows, ["g"], ["i"], "v", "p").orderBy("i").collect()] == [4, 4, 6, 6, None]
    assert [r.p for r in windows.fill_forward(rows, ["g"], ["i"], "v", "p").orderBy("i").collect()] == [None, 4, 4, 6, 6]


def test_text_metrics(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c d", "a x c d e"), (None, "new words"), ("old", None), (None, None)], "a string, b string")
    got = [r.m for r in rows.select(pandas_text.text_metrics(F.col("a"), F.col("b")).alias("m")).collect()]
    assert [g.sequence_ratio for g in got] == [1.0, 0.666667, 0.0, 0.0, 1.0] and got[1].added == ["x", "e"] and got[1].removed == ["b"]
    assert [g.word_delta for g in got] == [0, 1, 2, -1, 0]


def test_chunks():
    text = "short\nof two lines\n\nalso short\n \n" + "A sentence here. " * 30 + "\n\n" + "word " * 60
    got = pandas_text.chunks(text, 200, 40)
    assert got[0] == ("short of two lines\n\nalso short" + "\n\n" + " ".join(["A sentence here."] * 30))[: len(got[0])]
    assert all(0 < len(c) <= 200 for c in got) and pandas_text.chunks("", 200, 40) == []
    assert " ".join(" ".join(got).split()) == " ".join(text.split())  # nothing is lost
    assert pandas_text.chunks("one\n\ntwo", 200, 2) == ["one", "two"] and pandas_text.chunks("a\n\ntwo", 200, 2) == ["a\n\ntwo"]
    assert pandas_text.chunks("First one. Second one. third", 12, 0) == ["First one.", "Second one.", "third"]


def cut(text):
    """Sentences by a walk over the words: the same rule, written once more for the test."""
    import re

    for a, b in zip(*X.TYPOGRAPHY, strict=True):
        text = text.replace(a, b)
    out = []
    for line in re.sub(r"\s*•\s*", "\n• ", " ".join(text.split())).split("\n"):
        words, held = line.split(), []
        for k, w in enumerate(words):
            held.append(w)
            after = words[k + 1] if k + 1 < len(words) else ""
            opens = after.lstrip("\"'([")[:1] if after[:1] in "\"'([" and after[1:2] not in "\"'([" else after[:1]
            ends = w[-1] in ".!?" and bool(re.match("[A-Z0-9]", opens))
            tail = " ".join(held)
            if any(tail.endswith(a) for a in X.ABBREVIATIONS) or (tail.endswith("Cal.") and after.startswith("App.")):
                ends = False
            if re.search(r"\b[A-Za-z]\.$", w) and re.match("[A-Z0-9]", after):
                ends = False
            if re.search(r"\b[A-Z]\.[A-Z]\.$", w):
                ends = False
            if re.search(r'"[^"]{0,200}\bnote \d{1,3}\.$', tail, re.I) and after[:1].isalpha():
                ends = False
            if ends or k + 1 == len(words):
                out.append(" ".join(held))
                held = []
    return [s for s in out if s]


def test_sentences_of_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("text").collect()
    texts = [r.text for r in rows] + ['See "Note 12. Leases" and Cal. App. Fourth. The U.S.A. Office of J. P. Morgan Co. Ltd. spoke. (It did.) "Yes." No. 5', "a•b. C•D", "", "Taco. Bell i.e. X. Y. Zed vs. Them"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.sentences(F.col("t")).alias("s")).collect()]
    assert got == [cut(t) for t in texts]


def test_markup():
    html = "<p>One <b>two</b></p><script>x</script><ul><li>a</li></ul><p style='display:none'>gone</p><table><tr><td rowspan=2>x</td><td colspan=2>y</td></tr><tr><td>z</td></tr></table>"
    assert [(b[1], b[2], b[3], b[4], b[5]) for b in markup.page_blocks(html)][:2] == [("p", 0, True, True, "One two"), ("li", 1, False, False, "a")]
    assert [(c[1], c[2], c[5]) for c in markup.page_cells(html)] == [(0, 0, "x"), (0, 1, "y"), (0, 2, "y"), (1, 0, "x"), (1, 1, "z")]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=SUM(A1)", "x"), (2, "-12.5%", "y"), (3, "a\tb\nc", "x")], "k int, t string, p string")
    stores.write_delimited(rows.coalesce(1), str(tmp_path / "csv"))
    assert [r.t for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("k").collect()] == ["'=SUM(A1)", "-12.5%", "a b c"]
    digest = stores.publish(rows, str(tmp_path / "snap"))
    assert stores.published(spark, str(tmp_path / "snap"), digest).count() == 3 and stores.revision(rows.repartition(3)) == digest
    with pytest.raises(ValueError):
        stores.published(spark, str(tmp_path / "snap"), "other")
    stores.replace_partitions(rows, str(tmp_path / "part"), ["p"])
    stores.replace_partitions(rows.where("k = 1"), str(tmp_path / "part"), ["p"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "part")).collect()) == [1, 2]
    wide = spark.createDataFrame([("x", [1, 2], ["a", "b"])], "c string, n array<int>, s array<string>")
    assert [(r.c, r.n, r.s) for r in stores.explode_columns(wide, ["n", "s"]).collect()] == [("x", 1, "a"), ("x", 2, "b")]
    (tmp_path / "r.json").write_text('[{"id": "1", "text": "A b."}, {"id": "1", "text": "c"}]')
    chunks = stores.read_records(spark, str(tmp_path / "r.json"))
    sents = spark.createDataFrame([("s1", "1", "A  b."), ("s2", "9", "x")], "id string, chunk_id string, text string")
    assert sorted({r.problem for r in stores.check_records(chunks, sents).collect()}) == ["no paragraph", "not in its paragraph", "repeated id"]
    nested = stores.nested(rows, [(["p"], "parts", ["k", "t"])])
    assert {r.p: [x.k for x in r.parts] for r in nested.collect()} == {"x": [1, 3], "y": [2]}


def test_questions(spark, small):
    plan = questions.parse("How many changes did src3 and src0 make in en from 2020 to 2022 with materiality above 0.5? top five", ("src0", "src3"), ("en", "de"))
    f = plan.filters
    assert plan.intent == "count" and f.companies == ("src3", "src0") and f.items == ("en",) and (f.previous_year, f.current_year) == (2020, 2022) and f.min_strict and f.limit == 5 and plan.exclude_unchanged
    rows = changes(spark, small)
    for q in ("show match 3", "which labels disagree", "lowest confidence", "compare src0 versus src1", "breakdown by status and item", "how many were removed", "most material changes", "summary", "list new in 2021"):
        got = questions.answer(q, rows, ("src0", "src1"), ("en",))[1]
        assert got and all(frame.limit(1).collect() is not None for frame in got.values())
    after = questions.follow_up(questions.parse("and in de?", (), ("en", "de")), plan)
    assert after.filters.items == ("de",) and after.filters.companies == ("src3", "src0")


def test_guard(spark, small):
    changes(spark, small).createOrReplaceTempView("alignment_changes")
    assert questions.guarded(spark, "WITH x AS (SELECT item FROM alignment_changes) SELECT item, count(*) FROM x GROUP BY item").count() > 0
    for bad in ("DROP TABLE alignment_changes", "SELECT * FROM secrets", "SELECT 1; SELECT 2", "INSERT INTO alignment_changes SELECT 1", "SELECT * FROM alignment_changes a JOIN other b ON a.item = b.item", "not sql"):
        with pytest.raises(ValueError):
            questions.guarded(spark, bad)
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.name') FROM alignment_changes", "SELECT `reflect`('a', 'b') FROM alignment_changes", "SELECT java_method('a', 'b') FROM alignment_changes", "SELECT item FROM alignment_changes WHERE length(input_file_name /* */ ()) > 0", "SELECT * FROM range(5), alignment_changes"):
        with pytest.raises(ValueError):
            questions.guarded(spark, bad)
    assert questions.guarded(spark, "SELECT item, round(avg(n_chars), 1) AS a FROM alignment_changes WHERE item IN ('reflect(x)', 'en') GROUP BY item").count() > 0


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at + datetime.timedelta(minutes=20 * i), "k", i) for i in range(6)], "ts timestamp, kind string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("v", T.IntegerType())])
    query = feeds.windowed_counts(feeds.feed(spark, str(tmp_path / "in"), schema), "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counts").collect()) == [3, 3]
    feeds.keep_latest(feeds.feed(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), ["kind", "v"], str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_component_labels_of_all_edges(spark, small):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_suppkey", "l_orderkey").collect():
        x, y = find(r.l_suppkey), find(r.l_orderkey + 1_000_000_000)
        root[max(x, y)] = min(x, y)
    got = catalog.QUERIES["component_labels"](spark, small).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)


def test_export_rows_keeps_whole_texts(spark):
    rows = spark.createDataFrame([(1, "c", "i", "=" + "long text " * 50 + "\nend"), (2, "c", "i", "word " * 30)], "match_id long, company string, item string, text string")
    got = {r.match_id: r.cell for r in filters.export_rows(rows).collect()}
    assert got == {1: "'=" + "long text " * 50 + " end", 2: "word " * 30}


def test_title_shares_read_whole_texts(spark, tmp_path):
    rows = [(1, "Title Words " * 20 + "and then lower words " * 40), (2, "lower " * 50 + "Upper " * 150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.share for r in catalog.QUERIES["title_shares"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.25, 2: 0.75}
