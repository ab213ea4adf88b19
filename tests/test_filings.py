"""Headings, page marks, sections, discovery and peers on small tables."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import headings
from ledgerline.operators import peers
from ledgerline.sources import filings


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("text,item,title", [("Item 1A. Risk Factors", "1A", "Risk Factors"), ("PART II  ITEM 7 - Management's Discussion", "7", "Management's Discussion"), ("item 15", "15", ""), ("Items of note", None, None), ("See Item 7", None, None), ("Item 10. x", None, None)])
def test_item_heading(spark, text, item, title):
    a, b = headings.item_heading(F.col("t"))
    row = frame(spark, [(text,)], "t string").select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b) == (item, title)


def test_small_predicates(spark):
    rows = frame(spark, [("7", "See pages 12 to 30 of the annual report. More.", 1), ("7", "Revenue grew. See page 3.", 1), ("1", "See page 3 of the annual report.", 1), ("8", "x" * 500, 1)], "i string, t string, n int")
    assert [r.x for r in rows.select(headings.is_pointer(F.col("i"), F.col("t"), F.col("n")).alias("x")).collect()] == [True, False, False, False]
    n, t = headings.footnote(F.col("t"))
    notes = frame(spark, [("(1) Includes all units",), ("12Restated figures",), ("[[FNREF:4]] As restated later",), ("1234 Not a note at all",), ("3 short",), ("no note here",)], "t string").select(n.alias("n"), t.alias("t")).collect()
    assert [(r.n, r.t) for r in notes] == [(1, "Includes all units"), (12, "Restated figures"), (4, "As restated later"), (None, None), (None, None), (None, None)]
    pages = frame(spark, [("Page 12 of 90",), ("- 7 -",), ("12",), ("page twelve",)], "t string").select(headings.page_number(F.col("t")).alias("p")).collect()
    assert [r.p for r in pages] == [12, 7, None, None]
    assert frame(spark, [("Note 3. Leases:", "8")], "t string, i string").select(headings.section_key(F.col("i"), F.col("t")).alias("k")).first().k == "8:leases"


def test_page_marks(spark):
    bare = [("a", i, str(i // 3 + 1) if i % 3 == 2 else "text") for i in range(90)]
    short = [("b", i, str(i)) for i in range(10)]
    labelled = [("c", 0, "x"), ("c", 1, "Page 4"), ("c", 2, "17"), ("c", 3, "y")]
    blocks = frame(spark, bare + short + labelled, "doc string, pos int, text string")
    marks = filings.page_marks(blocks, "doc", "pos", "text")
    got = {(r.doc, r.pos): r.page for r in marks.collect()}
    assert got == {**{("a", i): i // 3 + 1 for i in range(90) if i % 3 == 2}, ("c", 1): 4}
    pages = {(r.doc, r.pos): r.page for r in filings.numbered(blocks, marks, "doc", "pos").collect()}
    assert pages["a", 0] == 1 and pages["a", 3] == 2 and pages["c", 0] == 4 and pages["c", 3] is None and pages["b", 5] is None


def test_sections_and_paths(spark):
    rows = [(0, "Item 1. Business"), (1, "Item 7. MD&A"), (2, "Item 1. Business"), (3, "We sell."), (4, "A lot of it."), (5, "Item 7. MD&A"), (6, "It grew.")]
    got = filings.item_sections(frame(spark, [("d", p, t) for p, t in rows], "doc string, pos int, text string"), "doc", "pos", "text")
    assert {r.item: (r.start, r.end) for r in got.collect()} == {"1": (2, 4), "7": (5, 6)}
    tree = [(0, 1, "A"), (1, 2, "A1"), (2, None, "text"), (3, 2, "A2"), (4, 3, "A2x"), (5, 1, "B"), (6, None, "text")]
    paths = filings.section_paths(frame(spark, [("d", *r) for r in tree], "doc string, pos int, level int, text string"), "doc", "pos", "level", F.col("text"), 3)
    assert {r.pos: r.path for r in paths.collect()} == {0: ["A"], 1: ["A", "A1"], 2: ["A", "A1"], 3: ["A", "A2"], 4: ["A", "A2", "A2x"], 5: ["B"], 6: ["B"]}


def test_discovery(spark):
    rows = [("c1", ["10-K", "10-Q", "10-K"], ["2023-12-31", "2023-09-30", "2022-12-31"], ["x", "y", "z"]), ("c2", ["10-K", "10-K"], ["2023-06-30", "2023-12-31"], ["p", "q"])]
    got = filings.annual_reports(frame(spark, rows, "cik string, form array<string>, reportDate array<string>, accession array<string>"), ["form", "reportDate", "accession"], "2023")
    assert sorted((r.cik, r.accession, r.candidates) for r in got.collect()) == [("c1", "x", 1), ("c2", "p", 2), ("c2", "q", 2)]


def test_peers(spark):
    rows = [("A", "B", "d1", 1, "r1", "same_topic", 0.5, 1), ("A", "B", "d1", 2, "r2", "related", 0.9, 2), ("B", "A", "d9", 1, "r1", "same_topic", None, 3), ("A", "C", "d1", 5, "r5", "same_topic", 1.0, 4)]
    pairs = frame(spark, rows, "target string, peer string, target_disclosure_id string, saved_at int, run_id string, relationship string, score double, comparison_id int")
    assert [r.comparison_id for r in peers.lookup(pairs, "B", "A").collect()] == [3, 2]
    results = frame(spark, [("d1", "B", 1, "r1", "no_match"), ("d1", "B", 2, "r2", "compared"), ("d2", "B", 1, "r1", "no_match")], "target_disclosure_id string, peer string, saved_at int, run_id string, status string")
    assert [r.target_disclosure_id for r in peers.without_counterpart(results).collect()] == ["d2"]
    runs = frame(spark, [("A", 2024, ["b ", "B", "c"]), ("D", 2024, ["A"])], "target string, fiscal_year int, peers array<string>")
    assert peers.coverage(runs, ["A"], 2024).count() == 2 and runs.select(peers.source_key(F.col("peers")).alias("k")).first().k == ["B", "C"]
    assert peers.wanted_pairs(["b", "a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    nested = spark.createDataFrame([("A", 2024, [{"target_disclosure_id": "d1", "peer_results": [{"peer_ticker": "B", "status": "compared", "comparisons": [{"peer_disclosure_id": "x", "score": 0.5}]}]}])], "target string, fiscal_year int, comparisons array<struct<target_disclosure_id:string,peer_results:array<struct<peer_ticker:string,status:string,comparisons:array<struct<peer_disclosure_id:string,score:double>>>>>>")
    flat = peers.flatten(nested)
    assert flat["comparisons"].first().peer_disclosure_id == "x" and flat["results"].first().status == "compared" and flat["targets"].count() == 1
    labels = frame(spark, [("d1", "2023_2024", "Modified"), ("d1", "2022_2023", "New")], "target_disclosure_id string, window string, label string")
    assert [c.label for c in peers.with_yearly_context(results.limit(1), labels, "target_disclosure_id").first().context] == ["New", "Modified"]
