"""The n-gram join and the pipeline against brute force; HTML extraction against pages whose text is known."""

import collections
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from ledgerline.llm import hashing, html_extract, mixing, ngram_join, quality, token_store  # noqa: E402

MIDDLE = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(texts):
    """Position -> the first position of its component, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for t in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = collections.Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def copies(rng, n=160):
    """Texts in groups of near copies of all sizes, some over a passage that many share."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 20, 40, 100, 300]))]
        if rng.random() < 0.4:
            base[rng.randrange(len(base)) :] += passage
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
                w = w or [word()]
            out.append(rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed, monkeypatch):
    texts = [None, "", " \n", "one", "One", "one two three four", "É é", "x " * 4000, "x " * 3999, *copies(random.Random(seed))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    sizes, roots = linked(texts)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_join_finds_every_link(spark):
    texts = [None, "", "one", *copies(random.Random(4))]
    sets = [frozenset(shingles(t)) for t in texts]
    different = sorted({s for s in sets if s}, key=sorted)
    many = collections.Counter()
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if 4 * len(a & b) >= 3 * len(a | b):
                many.update([a, b])
    assert max(many.values()) > ngram_join.FEW
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.join(docs, links=True).collect()}
    _, roots = linked(texts)
    assert got == {i: (roots[i], many[sets[i]]) for i in range(len(texts))}


def test_join_on_the_table(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").collect()
    sizes, roots = linked([d.text for d in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op7_ngram_join(spark, MIDDLE).collect()}
    assert got == {d.doc_id: (sizes[i], docs[roots[i]].doc_id) for i, d in enumerate(docs)}


def test_join_sql(spark):
    from oracles import rows_of_frame, rows_of_sql

    assert rows_of_frame(ngram_join.op7_ngram_join(spark, MIDDLE)) == rows_of_sql(ngram_join.ORACLE, MIDDLE)


def test_join_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (None, "lone words"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())
    assert got == collections.Counter([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (None, 1, None), (9, 0, 9)])
    kept = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect())
    assert kept == collections.Counter([(4, "a b c d e f"), (None, None), (None, "lone words"), (9, None)])
    assert ngram_join.join(docs.limit(0)).count() == 0 and ngram_join.one_of_each(docs.limit(0)).count() == 0


def keys_of(sets, often, spread=1):
    flat = np.concatenate(sets)
    return ngram_join.segment_keys(flat, np.cumsum([0, *map(len, sets)]), often, spread)


def shared_keys(a, b, often):
    which, key, crowded = keys_of([b, a, np.zeros(0, np.uint64)], often)
    alone = keys_of([a], often)[1]
    assert sorted(key[which == 1].tolist()) == sorted(alone.tolist()) and not crowded
    return len(np.intersect1d(key[which == 0], key[which == 1]))


def test_sketch_bounds():
    rng = np.random.default_rng(3)
    none = np.zeros(1 << ngram_join.FREQUENT_BITS, np.uint8)
    often = none.copy()
    often[rng.integers(0, len(often), len(often) // 2)] = 1
    for n in (3, 7, 8, 10, 63, 64, 100, 500, 511, 512, 3000):
        base = np.unique(rng.integers(0, 2**64 - 1, 2 * n, dtype=np.uint64))
        rng.shuffle(base)
        for _ in range(20):
            gone = int(rng.integers(0, n // 4 + 1))
            extra = int(rng.integers(0, n // 4 + 1))
            a, b = np.sort(base[:n]), np.sort(np.append(base[gone:n], base[n : n + extra]))
            both = n - gone
            sketch, begin = ngram_join.sketches_of(np.append(a, b), np.array([0, len(a), len(a) + len(b)]))
            p, q = sketch.view(np.uint64)[: begin[1]], sketch.view(np.uint64)[begin[1] :]
            words = min(len(p), len(q))
            apart = int(np.bitwise_count(ngram_join.fold(p, words) ^ ngram_join.fold(q, words)).sum())
            assert apart <= gone + extra
            if both * 4 >= (len(a) + len(b) - both) * 3 and gone + extra:
                least = ngram_join.SHARED if len(a) >= ngram_join.SMALL_BAND and len(b) >= ngram_join.SMALL_BAND else 1
                assert shared_keys(a, b, none) >= least
                assert shared_keys(a, b, often) >= least


def test_shingles_of_odd_texts(monkeypatch):
    texts = [None, "", " ", "a", "b c", "\u00c9 \u00e9", "A  b\tc\rd\ne f", "a b c d e f", "x" * 5000, "x" * 5001 + " y", "a b c d e a b c d e a", *copies(random.Random(9), 30)]
    whole, bounds = ngram_join.shingle_sets(*hashing.texts_of(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    names = ngram_join.names_of(whole, bounds)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (names[i] == names[j]) == (shingles(a) == shingles(b))
            x, y = whole[bounds[i] : bounds[i + 1]], whole[bounds[j] : bounds[j + 1]]
            assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b))
    # blocks of any size give the same
    monkeypatch.setattr(hashing, "BLOCK_BYTES", 16)
    monkeypatch.setattr(hashing, "_powers", [])
    again, _ = ngram_join.shingle_sets(*hashing.texts_of(pa.array(texts)))
    assert (again == whole).all()


def test_join_in_small_blocks(spark, monkeypatch):
    """Large groups in many blocks, hot segments and too few segments, by the same brute force."""
    for name, value in (("BLOCK_SETS", 4), ("LEADS", 1), ("FEW", 3), ("HELD_KEYS", 500), ("BUCKET_KEYS", 1000), ("SMALL_SEGMENTS", 16)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = [None, "", "one", *copies(random.Random(5), 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes, roots = linked(texts)
    want = {i: (sizes[i], roots[i]) for i in range(len(texts))}
    for links in (False, True):
        rows = ngram_join.join(docs, links=links).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        if links:
            sets = [frozenset(shingles(t)) for t in texts]
            different = {s for s in sets if s}
            many = {a: sum(a != b and 4 * len(a & b) >= 3 * len(a | b) for b in different) for a in different}
            assert {r.doc_id: r.n_links for r in rows} == {i: many.get(s, 0) for i, s in enumerate(sets)}


def test_large_groups_across_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    sets = [(i, 500, [i] * 64, i // 10) for i in range(40)]
    classes = spark.createDataFrame([(a, n, s) for a, n, s, _ in sets], "cid long, n_shingles long, sketch array<long>")
    roots = spark.createDataFrame([(a, r) for a, _, _, r in sets], "cid long, root long")
    groups = spark.createDataFrame([(1, a) for a, *_ in sets], "key long, cid long")
    got = {(r.a, r.b) for r in ngram_join.across(groups, roots, classes).collect()}
    near = lambda x, y: 64 * bin(x ^ y).count("1") * 7 <= 2 * 500
    assert got and all(x // 10 != y // 10 and near(x, y) for x, y in got)
    label = {x: x // 10 for x in range(40)}

    def join_all(pairs):
        found = dict(label)
        for x, y in pairs:
            old, new = found[y], found[x]
            found = {k: new if v == old else v for k, v in found.items()}
        return {frozenset(k for k in found if found[k] == v) for v in found.values()}

    assert join_all(got) == join_all([(x, y) for x in range(40) for y in range(40) if near(x, y)])


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var x="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div>{main}<aside class="sidebar"><p>side</p></aside>
<form><p>form text</p><input name="a>b"></form><div id="comments-12"><p>a reader says</p></div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    first = "<article><h1>A &amp; B</h1><p>one\n <b>two</b> three&nbsp;four<p>second<br>line &lt;p&gt;<div class='ad x'>buy</div></article>"
    other = "<div class='post-content'><h2>Head</h2><p>body &#x41;</p><ul><li>x<li>y</ul><script>no()</script></div>"
    plain = "<div><div><p>all of the long text here</p><p>more of it</p></div></div>"
    rows = [(1, "http://a.org/1", PAGE.format(main=first)), (2, "http://A.org/2", PAGE.format(main=other)), (3, "http://b.org/", PAGE.format(main=plain)), (4, None, None), (5, "", ""), (6, "http://c.org", "just text &amp"), (6, "http://c.org", "just text &amp"), (7, "http://d.org", "<p>" * 3000 + "deep" + "<article><p>cut"), (8, "http://a.org/8", "<article><p>" + "long " * 50_000 + "</article>")]
    got = {r.page_id: r.main_text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\none two three four\nsecond line <p>"
    assert got[2] == "Head\nbody A\nx\ny"
    assert got[3] == "all of the long text here\nmore of it"
    assert got[4] == got[5] == "" and got[6] == "just text &"
    assert got[7] == "cut" and got[8] == ("long " * 50_000).strip()
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert html_extract.extract(empty).count() == 0


def test_html_without_a_named_container_keeps_all_text(spark):
    page = "<html><body><nav>menu</nav><h1>{0} title</h1><div><p>{1}</p></div><section><p>{2}</p></section><div>same words</div></body></html>"
    long, third = "long text of it " * 30, "a third of the article " * 9
    rows = [(1, "http://one.org/1", page.format("A", long, third))]
    rows += [(10 + k, f"http://two.org/{k}", page.format(f"B{k}", f"{k} {long}", f"{k} {third}")) for k in range(6)]
    # a rarer layout, with one line where the host's pages have their text
    rare = "<html><body><div><p>one line</p></div><table><tr><td>" + long + "</td></tr></table></body></html>"
    named = lambda k: f"<html><body><article><p>{k} {long}</p></article></body></html>"
    rows += [(20 + k, f"http://three.org/{k}", named(k)) for k in range(6)]
    rows += [(30, "http://three.org/30", "<html><body><article><p>one line</p></article><main><h2>Head</h2></main></body></html>")]
    rows += [(40 + k, f"http://four.org/{k}", f"<html><body><div><p>{k} {long}</p></div></body></html>") for k in range(6)] + [(50, "http://four.org/50", rare)]
    rows += [(60 + k, "http://five.org/", "<h1>Head</h1><p>a</p><p>b</p>") for k in range(2)]
    got = {r.page_id: r.main_text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    long, third = long.strip(), third.strip()
    assert got[1] == f"A title\n{long}\n{third}\nsame words"
    for k in range(6):
        assert got[10 + k].split("\n")[:3] == [f"B{k} title", f"{k} {long}", f"{k} {third}"]
        assert got[20 + k] == got[40 + k] == f"{k} {long}"
    assert got[30] == "one line"
    assert got[50] == f"one line\n{long}"
    assert got[60] == got[61] == "Head\na\nb"


def test_html_on_the_table(spark):
    from html import unescape

    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.op9_html_extraction(spark, MIDDLE).collect()}
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in parts]
        want = "\n".join(x for x in parts if x)
        assert got[p.page_id] == (want, len(want))


def test_html_slots_decide(spark):
    """What a host's pages have in one place goes, wherever it stands; what differs stays, whatever it is called."""
    share = "<p class='social'>Share this page</p>"
    page = "<div class='wrap'><div>Our site</div><article><h1>Same title</h1>{0}<p>{1} body</p><section class='share'><p>{1} more</p></section></article><p>All rights</p></div>"
    plain = "<html><body><div>Our site</div><table><tr><td><h2>{0} head</h2>{0} cell<td>{0} other</table><div>Written by us</div></body></html>"
    two = "<main><p>{0} in main</p></main><div>{0} x</div>"
    rows = [(k, "http://a.org/", page.format(share, f"{k} " * 9)) for k in range(6)]
    rows += [(10 + k, "http://b.org/", plain.format(f"{k}")) for k in range(6)] + [(20 + k, "http://b.org/", plain.format("0")) for k in range(3)]
    rows += [(30 + k, "http://c.org/", (two if k % 2 else page).format(*(["", f"{k} " * 9] if k % 2 == 0 else [f"{k} " * 9]))) for k in range(8)]
    rows += [(40 + k, "http://d.org/", "<article><h1>t</h1><p>same for both</p><ul><li>a<li>a</ul></article>" + " " * k) for k in range(2)]
    got = {r.page_id: r.main_text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    nine = lambda k: " ".join([str(k)] * 9)
    for k in range(6):
        assert got[k] == f"Same title\n{nine(k)} body\n{nine(k)} more"
        assert got[10 + k] == f"{k} head\n{k} cell\n{k} other"
    assert got[20] == got[21] == got[22] == got[10]
    for k in range(8):
        assert got[30 + k] == (f"{nine(k)} in main" if k % 2 else f"Same title\n{nine(k)} body\n{nine(k)} more")
    assert got[40] == got[41] == "t\nsame for both\na\na"


def test_html_of_any_depth_and_width(spark):
    deep = lambda k: "<div>" * 5000 + f"text {k}" + "</div>" * 5000
    rng = random.Random(3)
    wide = lambda k: "".join(f"<{rng.choice(['p', 'h2', 'ul', 'table'])}>w{k}.{i} " for i in range(1500))
    rows = [(k, "http://deep.org/", deep(k)) for k in range(4)] + [(9, "http://one.org/", deep(9))]
    rows += [(10 + k, "http://wide.org/", wide(k)) for k in range(3)]
    got = {r.page_id: r.main_text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (0, 1, 2, 3, 9):
        assert got[k] == f"text {k}"
    for k in range(3):
        assert got[10 + k].split("\n") == [f"w{k}.{i}" for i in range(1500)]


def test_wrappers():
    pages = ["<div><p>a</p><p>b</p><h2>x</h2></div>", "<div><p>c</p><hr><h2>x</h2></div>", "<div><ul><li>1</li><li>2</li></ul><h2>x</h2></div>"]
    whole = None
    for p in pages:
        own = html_extract.tree(p)
        whole = own if whole is None else html_extract.host_aligned(whole, own)
    assert html_extract.reread(html_extract.written(whole)) == whole
    assert html_extract.pattern(whole) == "<div> (<ul> (<li> #text </>)+ </>)? (<p> #text </>)+? (<hr>  </>)? <h2> 'text' </> </>".replace("(<ul> (<li> #text </>)+ </>)? (<p> #text </>)+? (<hr>  </>)?", html_extract.pattern(["", 0, 0, whole[3][0][3][:-1]]))
    kinds = {n[0]: n for n in whole[3][0][3]}
    assert kinds["p"][1] and kinds["p"][2] and kinds["hr"][2] and kinds["ul"][2] and not kinds["h2"][2] and kinds["h2"][3][0][2] is not None
    assert len(kinds["h2"][3][0][4]) == 3
    squares = html_extract.tree("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>")
    assert html_extract.pattern(squares) == "<dl> (<dt> #text </> <dd> #text </>)+ </>"
    six = "<h1>a</h1><p>b</p><h2>c</h2><ul>d</ul><h3>e</h3><ol>f</ol>"
    assert html_extract.pattern(html_extract.tree(six * 3)) == "(<h1> 'text' </> <p> 'text' </> <h2> 'text' </> <ul> 'text' </> <h3> 'text' </> <ol> 'text' </>)+"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = docs.collect()
    good = corpus_pipeline.quality_stage(spark, docs, MIDDLE)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    scores = {r.doc_id: r.score for r in quality.op10_quality(spark, MIDDLE).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.97
    single = corpus_pipeline.near_copies_stage(spark, docs, MIDDLE)
    assert single.columns == docs.columns
    ordered = sorted(rows, key=lambda r: r.doc_id)
    _, roots = linked([r.text for r in ordered])
    assert sorted(r.doc_id for r in single.collect()) == sorted({ordered[i].doc_id for i in roots})
    clean = corpus_pipeline.decontaminate_stage(spark, docs, MIDDLE)
    assert clean.columns == docs.columns and 0 < clean.count() < len(rows)
    mixed = corpus_pipeline.mix_stage(spark, docs, MIDDLE)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(r.doc_id for r in mixing.op2_mix_sources(spark, MIDDLE).collect())


def test_pipeline_from_end_to_end(spark):
    out = corpus_pipeline.run(spark, MIDDLE).orderBy("start").collect()
    assert len(corpus_pipeline.STAGES) == 5 and out
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, MIDDLE).collect(), docs.schema)
    t = token_store.encoder(token_store.default_vocabulary()).tokenizer
    want = collections.Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens


def test_stages_take_odd_tables(spark):
    rows = [(None, None, None, None, None, "c"), (1, "", "en", "s", 0, "c"), (1, "", "en", "s", 0, "c"), (2, "word " * 60_000, "en", "s", 5, "c"), (3, "some plain words that are here", None, None, 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_row` string")
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, MIDDLE)
            out.collect()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
