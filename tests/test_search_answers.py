"""Search and answers by brute force and by cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import alignment, extraction, search
from ledgerline.plans import alignment_queries, answers

THESAURUS = {"tariff": ["tariff", "customs duty", "levy"], "risk": ["risk", "hazard"]}


def covers(query, fields):
    """All stretches that fit and hold no smaller one that does."""
    entries, at = [], 0
    for text, weight in fields:
        for w in search.words(text):
            at += 1
            if w in search.wanted(query):
                entries.append((at, w, weight))
    ok = [(i, j) for i in range(len(entries)) for j in range(i, len(entries)) if search.fits(query, search.places_of(entries[i : j + 1]))]
    least = [(i, j) for i, j in ok if not any((a, b) != (i, j) and i <= a and b <= j for a, b in ok)]
    total = 0.0
    for i, j in least:
        part = entries[i : j + 1]
        total += len(part) / sum(1 / w for _, _, w in part) / (1 + (part[-1][0] - part[0][0]) - (len(part) - 1))
    return total / (total + 1) if ok else None


QUERIES = [search.any_phrase(["export controls", "levy"]), search.plain("risk tariff"), search.strict_topic("tariff risk", THESAURUS), search.strict_topic("tariff", THESAURUS), search.websearch('"customs duty" -hazard or levy')]


@pytest.mark.parametrize("query", QUERIES)
def test_cover_density(query):
    rng = random.Random(3)
    vocabulary = "export controls levy risk tariff customs duty hazard the of".split()
    for _ in range(60):
        fields = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))), w) for w in (1.0, 0.4, 0.2)]
        assert search.cover_density(query, fields) == pytest.approx(covers(query, fields)) if covers(query, fields) is not None else search.cover_density(query, fields) is None


def test_search_on_frames(spark):
    rows = [(1, "Tariff risk", None), (2, "x", "the levy and the risk"), (3, None, None), (4, "tariffs", "nothing"), (1, "Tariff risk", None)]
    texts = spark.createDataFrame(rows, "k long, a string, b string")
    got = [(r.k, r["rank"]) for r in search.ranked(texts, "k", {"a": "A", "b": "C"}, QUERIES[2]).collect()]
    want = [(k, round(covers(QUERIES[2], [(a, 1.0), (b, 0.2)]), 6)) for k, a, b in rows if covers(QUERIES[2], [(a, 1.0), (b, 0.2)]) is not None]
    assert sorted(got) == sorted(want) and len(got) == 3
    assert search.ranked(texts.limit(0), "k", {"a": "A"}, QUERIES[0]).count() == 0 and search.ranked(texts, "k", {"a": "A"}, search.any_phrase([])).count() == 0
    dense = spark.createDataFrame([(4, 0.9), (1, 0.8)], "k long, rank double")
    fused = search.hybrid({"dense": dense, "text": search.ranked(texts.distinct(), "k", {"a": "A", "b": "C"}, QUERIES[2])}, "k", "rank", 3).collect()
    assert fused[0].k == 1 and fused[0].methods == ["dense", "text"] and len(fused) == 3


def test_queries_are_built():
    assert search.expanded("tariff risk", THESAURUS) == ["tariff risk", "tariff", "customs duty", "levy", "risk", "hazard"]
    assert search.expanded("x", {}) == ["x"] and search.expanded("", {}) == []
    assert search.like_patterns("the gross margins") == ["%gross%margins%", "%gross%", "%margin%"] and search.like_patterns("of the") == []
    assert search.wanted(QUERIES[4]) == {"customs", "duty", "levy"}


def test_index_scores(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta the of".split()) for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    frequency = {}
    for t in texts:
        for w in set(t.split()) - set(search.T.STOP_WORDS):
            frequency[w] = frequency.get(w, 0) + 1
    got = {(r.q, r.d): r.score for r in search.index_scores(rows.where("k < 3"), rows, "k", "t", 5).collect()}
    for q in range(3):
        scores = sorted(((-round(search.index_score(texts[q], t, frequency, len(texts)), 9), d) for d, t in enumerate(texts)))
        want = [(d, -s) for s, d in scores if s][:5]
        assert {d: s for (a, d), s in got.items() if a == q} == pytest.approx(dict(want))


def test_highlighted(spark):
    rows = spark.createDataFrame([("The cat sat.", "the CAT, sat"), ("a b c", "a x c d"), (None, "new"), (None, None)], "a string, b string")
    got = [r.h for r in rows.select(search.highlighted(F.col("a"), F.col("b")).alias("h")).collect()]
    assert [(h.removed, h.added, h.identical) for h in got] == [([], [], True), (["b"], ["x", "d"], False), ([], ["new"], False), ([], [], True)]


RUNS = ((2021, 2022), (2022, 2023), (2023, 2024))


@pytest.mark.parametrize("text,years", [("between 2022 and 2023", (2022, 2023)), ("2024 vs 2022", (2022, 2024)), ("the 2023 and 2024 filings", (2022, 2024)), ("since 2023", (2022, 2024)), ("the 2024 10-K", (None, 2024)), ("in 2021", (2021, None)), ("the latest filing", (None, 2024)), ("no year", (None, None)), ("2022 onwards", (2021, 2024))])
def test_years(text, years):
    assert answers.resolve_years(text, RUNS) == years


def test_topics_and_intents():
    assert answers.topic_of("What did Acme say about export controls in its 2024 10-K?", ("Acme",)) == "export controls"
    assert answers.topic_of("How has the climate risk language changed?") == "climate risk" or answers.topic_of("How has the climate risk language changed?") == "climate"
    assert answers.topic_of("List everything") is None
    ask = lambda q, t=None, f=False: answers.intent_of(q, t, f)
    assert ask("Show match 12") == ("match_detail", None) and ask("where do labels disagree") == ("disagreements", None)
    assert ask("net income growth") == ("financial", None) and ask("against its peers") == ("peer_compare", None)
    assert ask("compare A and B") == ("compare", None) and ask("least confident ones") == ("low_confidence", None)
    assert ask("summarise it") == ("summary", None) and ask("how many changed") == ("count", None) and ask("breakdown by item") == ("distribution", None)
    assert ask("material changes") == ("material", None) and ask("important changes", "tariffs") == ("topic", None)
    assert ask("x", "tariffs") == ("topic", None) and ask("x", None, True) == ("list", None) and ask("x") == ("custom_sql", None)
    assert ask("average number of changes") == ("custom_sql", "count") and ask("confidence below 60%") == ("low_confidence", None)


def test_findings_and_packs(spark):
    rows = [("a", 2020, 2022, ["f0", "f1"]), ("a", 2022, 2024, ["g0"]), ("b", 2020, 2024, ["h0"])]
    reports = spark.createDataFrame(rows, "company string, first_year int, last_year int, findings array<string>")
    assert [r.finding for r in answers.findings_of(reports, "a", 2022).collect()] == ["g0", "f0", "f1"]
    hits = spark.createDataFrame([("a", 1)], "company string, position int")
    assert [r.finding for r in answers.findings_of(reports, None, None, hits).collect()] == ["f1"]
    evidence = answers.pack({"numbers": spark.range(40), "none": spark.range(0)})
    assert len(evidence["numbers"]["rows"]) == 25 and evidence["numbers"]["more"] and not evidence["none"]["rows"]
    assert answers.templated("list", evidence) == "Numbers (25+ rows): id 0 | id 1 | id 2 | id 3 | id 4\nNone: nothing found."
    assert answers.templated("list", {}) == "No evidence for list."


def test_grounding():
    evidence = [{"id": "match_12", "text": "We “expect” tariffs — and levies — to raise our costs substantially.", "more": ["acme_2024_1A_P003"]}]
    answer = 'See match_12, [match_99] and acme_2024_1A_P003: "tariffs - and levies - to raise our costs" and "tariffs and levies ... a wholly invented part of it".'
    text, report = answers.grounded(answer, evidence)
    assert report.removed == ["match_99"] and "[unverified reference removed]" in text and report.checked == 2 and len(report.unverified) == 1 and not report.grounded
    assert answers.grounded("match_99", evidence, lambda ids: set(ids))[1].grounded
    assert answers.grounded("", [])[1].grounded


@pytest.mark.parametrize("kind,got,want,ok", [("number", 1.0000001, 1, True), ("number", None, 1, False), ("set", [1, 2], [2, 1], True), ("ordered", [1, 2], [2, 1], False), ("rows", [{"a": 1}], [{"a": "1"}], True), ("contains", "Up 5% in all", ["up 5%"], True), ("empty", [], None, True)])
def test_scorers(kind, got, want, ok):
    assert answers.score(kind, got, want) is ok


def test_jobs_are_whole_and_full(spark, small):
    rows = alignment_queries.verifier_jobs(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "n_chars").collect()}
    assert len(rows) == len(docs)
    jobs = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        jobs.setdefault((r.item, r.job), []).append(r.size)
    for (item, job), sizes in jobs.items():
        assert len(sizes) <= alignment.JOB_GROUPS and (sum(sizes) <= alignment.JOB_CHARACTERS or len(sizes) == 1)
        after = jobs.get((item, job + 1))
        assert after is None or len(sizes) == alignment.JOB_GROUPS or sum(sizes) + after[0] > alignment.JOB_CHARACTERS


def test_blended_similarity(spark):
    pairs = [("The cat sat.", "the cat sat."), ("a b", "c d"), (None, "x"), ("", ""), ("one two three", "one three two")]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(alignment.blended_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[3] == 1.0 and got[2] == 0.0 and 0 < got[4] < 1 and got[1] < 0.2


def test_walks_of_blocks(spark):
    rows = [("d", 0, "A [[FNREF:1]] [[FNREF:1]]", None, None), ("d", 1, "1 First note here", 1, "First note here"), ("d", 2, "1 Second note here", 1, "Second note here"), ("d", 3, "B [[FNREF:1]]", None, None), ("d", 4, None, None, None)]
    blocks = spark.createDataFrame(rows, "doc string, pos int, t string, note_no int, note string")
    got = [(r.pos, r.t) for r in extraction.inlined_footnotes(blocks, "doc", "pos", "t").orderBy("pos").collect()]
    note = "[footnote 1: First note here]"
    assert got == [(0, f"A {note} {note}"), (2, "1 Second note here"), (3, "B [footnote 1]"), (4, "")]
    assert extraction.inlined_footnotes(blocks.limit(0), "doc", "pos", "t").count() == 0
    indents = [0.0, 18.0, 36.0, 18.05, 9.0, 0.0, 5.0]
    items = spark.createDataFrame([("d", k, x) for k, x in enumerate(indents)], "doc string, pos int, indent double")
    assert [r.level for r in extraction.bullet_levels(items, "doc", "pos", "indent").orderBy("pos").collect()] == [1, 2, 3, 2, 2, 1, 2]


@pytest.mark.parametrize("sentence,paragraph,want", [("a well-known fact", "A a well -\nknown  fact.", "a well -\nknown  fact"), ("one two", "one  two one two x one  two", "one two"), ("one two", "one  two, one   two", None), ("cat", "concat", None), ("", "x", ""), (None, "x", None)])
def test_fitted_sentence(sentence, paragraph, want):
    assert extraction.fitted_sentence(sentence, paragraph) == want


def test_predicates_of_blocks(spark):
    rows = [("Liquidity and Capital", True), ("we saw that revenue rose", False), ("Results:", False), ("Item 7. Analysis", True), ("It ended.", True), ("• point", True)]
    frame = spark.createDataFrame(rows, "t string, b boolean")
    f, t = F.lit(False), F.col("t")
    assert [r.x for r in frame.select(extraction.is_subheader(t, F.col("b"), f, f, F.lit(None).cast("double"), f).alias("x")).collect()] == [True, False, True, False, False, False]
    pairs = [("it goes", "on here", True), ("It ended.", "Next", False), ("a list:", "• one", True), ("•", "point", True), ("• point", "next", False)]
    joins = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert [r.x for r in joins.select(extraction.joins_next(F.col("a"), F.col("b"), f, f).alias("x")).collect()] == [w for *_, w in pairs]
    assert list(itertools.chain(*pairs))
