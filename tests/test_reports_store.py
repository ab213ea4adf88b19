"""Readers, writers and stores of reports, on files."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import reports


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_disclosures(spark, tmp_path):
    row = {"disclosure_id": "acme_2024_1A_P001", "item": "1A", "section": "s", "summary": "", "content": "text", "sentence_ids": ["a"]}
    put(tmp_path / "disclosures.json", [row])
    put(tmp_path / "needs_review.json", [{**row, "disclosure_id": "ACME_2024_7_P002"}])
    got = reports.read_disclosures(spark, str(tmp_path), "Acme", 2024)
    assert sorted((r.disclosure_id, r.status) for r in got.collect()) == [("ACME_2024_7_P002", "needs_review"), ("acme_2024_1A_P001", "finalized")]
    put(tmp_path / "needs_review.json", [{**row, "disclosure_id": "other_2024_7_P002", "content": " "}])
    with pytest.raises(Exception, match="id, content"):
        reports.read_disclosures(spark, str(tmp_path), "acme", 2024).collect()


def test_alignments_and_synthesis(spark, tmp_path):
    good = {"match_id": "m1", "status": "ai_verified", "previous_ids": ["acme_2023_1"], "current_ids": ["acme_2024_1"], "review_reasons": []}
    assert reports.read_alignments(spark, put(tmp_path / "a.json", [good]), "acme", 2023, 2024).count() == 1
    for wrong in ({"status": "odd"}, {"previous_ids": ["acme_2024_1"]}, {"previous_ids": [], "current_ids": []}, {"review_reasons": ["x"]}):
        with pytest.raises(Exception, match="a record fails"):
            reports.read_alignments(spark, put(tmp_path / "b.json", [{**good, **wrong}]), "acme", 2023, 2024).collect()
    finding = {"title": "t", "text": "x", "evidence": ["acme_2024_1"]}
    assert reports.read_synthesis(spark, put(tmp_path / "s.json", [finding]), "acme").count() == 1
    with pytest.raises(Exception, match="own evidence"):
        reports.read_synthesis(spark, put(tmp_path / "s.json", [{**finding, "evidence": ["rival_2024_1"]}]), "acme").collect()


def test_exports_are_exact(spark, tmp_path):
    row = {"cik": "123", "concept": "c", "unit": "USD", "period": "p", "value": "12345678901234567890.0000000001", "status": "reported"}
    got = reports.read_export(spark, put(tmp_path / "x.json", [row, {**row, "value": None, "status": "nil"}]), "0000000123").collect()
    assert str(got[0].value) == "12345678901234567890.0000000001" and got[1].value is None
    for wrong, cik in (({"value": "NaN"}, None), ({"value": None}, None), ({}, "9")):
        with pytest.raises(Exception, match="a record fails"):
            reports.read_export(spark, put(tmp_path / "y.json", [{**row, **wrong}]), cik).collect()
    rows = spark.createDataFrame([("a", 2024, "e1"), ("b", 2024, "e2")], "company string, year int, extraction_id string")
    assert reports.filtered_export(rows, year=2024).count() == 2 and reports.filtered_export(rows, "a", 2024, "e2").count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "new", "Came  in"), ("7", "old", "Went")], "item string, side string, sentence string")
    reports.write_differences(rows, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/by_item")).count() == 2 and [r.value for r in spark.read.text(str(tmp_path / "d/text/item=1")).collect()] == ["+ Came in"]
    reports.write_by_status(rows.withColumn("status", F.col("side")), str(tmp_path / "s"))
    assert {r.status for r in spark.read.json(str(tmp_path / "s")).collect()} == {"new", "old"}
    chunks = spark.createDataFrame([("c1", "One two. Three.")], "id string, text string")
    sentences = spark.createDataFrame([("s1", "c1", "One two."), ("s2", "c1", "three.")], "id string, chunk_id string, text string")
    assert reports.write_chunks(chunks, sentences, str(tmp_path / "c")) == 1 and spark.read.json(str(tmp_path / "c/sentences")).count() == 2


def test_vectors(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "k int, t string")
    cache = texts.where("k = 1").select(reports.embedding_key("m", F.col("t")).alias("key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    found, lost = reports.cached_vectors(texts, cache, "m", "t", 2)
    assert [r.k for r in found.collect()] == [1] and sorted(r.t for r in lost.collect()) == ["b", "c"]
    assert reports.cached_vectors(texts, cache, "other", "t", 2)[0].count() == 0
    with pytest.raises(Exception, match="dimension"):
        reports.cached_vectors(texts, cache, "m", "t", 3)[0].collect()
    stored = texts.select("k", F.sha2(F.when(F.col("k") == 2, "old").otherwise(F.col("t")), 256).alias("text_sha256")).where("k < 4")
    assert sorted(r.k for r in reports.changed_texts(texts.withColumnRenamed("t", "text"), stored, ["k"]).collect()) == [2, 4]


def test_artifacts(spark, tmp_path):
    held = reports.Artifacts(spark, str(tmp_path / "store"))
    assert held.names() == [] and held.get("a/x.json") is None
    held.put("a/x.json", "é")
    held.put("a/x.json", "new é")
    held.put("b.txt", "")
    assert held.get("a/x.json") == "new é" and held.get("b.txt") == "" and held.names() == ["a/x.json", "b.txt"] and held.names("a/") == ["a/x.json"]
    assert held.move("b.txt", "c/d.txt") and held.names() == ["a/x.json", "c/d.txt"] and not held.move("lost", "there")
    with pytest.raises(ValueError):
        held.put("../x", "")


def test_filings_as_text(spark):
    sources = spark.createDataFrame([("https://x.test/ix?doc=/a/b.htm&q=1",), ("https://x.test/a.htm?x#y",)], "s string")
    assert [r.u for r in sources.select(reports.normal_source(F.col("s")).alias("u")).collect()] == ["/a/b.htm", "https://x.test/a.htm"]
    rows = [("d", 0, "p", "Item 1A. Risk Factors"), ("d", 1, "p", "body   text"), ("d", 2, "h2", "Part"), ("d", 3, "table", ""), ("d", 4, "p", "")]
    blocks = spark.createDataFrame(rows, "doc string, pos int, tag string, t string")
    events = [(r.pos, r.kind, r.item, r.title) for r in reports.structure_events(blocks, "doc", "pos", "tag", "t").orderBy("pos").collect()]
    assert events == [(0, "heading", "1A", "Risk Factors"), (2, "heading", None, "Part"), (3, "table", None, "")]
    assert reports.clean_text(blocks, "doc", "pos", "t").first().text.lstrip() == "Item 1A. Risk Factors\nbody text\nPart"
