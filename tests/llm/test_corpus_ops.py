"""Decontamination, mixing, token shards, quality and toxicity against brute force, SQL, round trips and held-out rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracles import rows_of_frame, rows_of_sql

from ledgerline.llm import decontaminate, mixing, quality, token_store, toxicity

MIDDLE = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - 9) if v else 0):
            x = v[k : k + 10]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (10, "short item"), (2, None), (3, ""), (4, "é"), (None, "null id item"), (1, "one two three four five six seven eight nine ten eleven twelve"), (5, "a a a a a a a a a a a a")]
TEXTS = [None, "", "!!", "x One two-three four five six seven eight nine TEN eleven", "short. ITEM", "shortitem É é", "two three four five six seven eight nine ten eleven twelve short item", "null id item", "a " * 30, "b a a a a a a a a a a b", "one two three four five six seven eight nine", "short", "x " * 3000 + "short item"]


@pytest.mark.parametrize("max_rows", [100_000, 4])
def test_decontaminate(spark, max_rows):
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, hits string, _all int, _hits_0 int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find(docs, bench, max_rows=max_rows).columns == ["doc_id", "text", "_all", "_hits_0", "n_words", "hits", "items"]
    out = decontaminate.find(docs, bench, max_rows=max_rows).withColumn("n", decontaminate.n_hit(decontaminate.F.col("hits"))).collect()
    assert len(out) == 2 * len(TEXTS)
    for r in out:
        assert (r.n_words, r.n, list(r["items"])) == brute(TEXTS[r.doc_id], ITEMS), TEXTS[r.doc_id]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[1]}
    assert decontaminate.find(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.find(docs.limit(0), bench).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), max_size=5), st.lists(st.text("ab ", max_size=60), max_size=5))
def test_decontaminate_windows(texts, items):
    rows = [(str(i), w.decode()) for i, t in enumerate(items) for w in decontaminate.windows_of(t)]
    block = decontaminate.Block(sorted(set(rows)))
    block.choose(block.frequencies(pd.Series(texts, dtype=object)))
    got = decontaminate.hit_rows(block, pd.Series(texts, dtype=object))
    for t, r in zip(texts, got.itertuples()):
        assert (r.n_words, sum(r.ends) - sum(r.starts), r.items) == brute(t, list(enumerate(items)))


@pytest.mark.parametrize("query,sql", [(decontaminate.op1_decontaminate, decontaminate.ORACLE), (mixing.op2_mix_sources, mixing.ORACLE)])
def test_sql(spark, query, sql):
    assert rows_of_frame(query(spark, MIDDLE)) == rows_of_sql(sql, MIDDLE)


def poisson(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing(spark):
    rows = [(i, "abc" * (i % 7), ["a", "b", None][i % 3], "mine") for i in range(600)] + [(None, None, "empty", "mine"), (5, "x", "late", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    weights = {"a": 3.0, "": 1.0, "late": 0.01}
    out = mixing.mix(docs, weights=weights, budget=40_000.0).collect()
    got = collections.Counter(r.doc_id for r in out)
    chars = collections.defaultdict(int)
    for _, t, s, _ in rows:
        chars[s] += len(t or "")
    for doc_id, t, s, _ in rows:
        rate = weights.get(s or "", 0) / 4.01 * 40_000 / chars[s] if chars[s] else 1.0
        parts = max(1, math.ceil(rate / mixing.PART))
        key = f"{mixing.SEED}|{'' if doc_id is None else doc_id}|{hashlib.md5((t or '').encode()).hexdigest()}"
        if doc_id != 5:
            assert got[doc_id] == sum(poisson(int(hashlib.md5(f"{key}|{j}".encode()).hexdigest()[:13], 16) / 2**52, rate / parts) for j in range(1, parts + 1))
    a = sum(len(r.text) for r in out if r.source == "a")
    assert abs(a / 40_000 - 3 / 4.01) < 0.1
    assert mixing.mix(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sllé.Œ \n\t ́٣µ!1<|endoftext|>中\x1c"), max_size=30), max_size=6))
def test_encoder_is_the_tokenizer(texts):
    e = token_store.encoder(token_store.default_vocabulary())
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "null id"), (-5, ""), (3, None), (3, "again"), (3, "again"), (2**62, "x " * 50_000)], "doc_id long, text string")
    every = docs.union(odd).repartition(5)
    manifest = token_store.write(every, str(tmp_path), token_store.default_vocabulary())
    got = token_store.read(manifest).orderBy("start").collect()
    t = token_store.encoder(token_store.default_vocabulary()).tokenizer
    want = collections.Counter((r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in every.collect())
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    assert len(token_store.lookup(manifest, 3)) == sum(1 for i in ids if i == 3) and token_store.lookup(manifest, 10**15) == []
    assert token_store.lookup(manifest, None)[0][-1] == 0
    assert token_store.read(token_store.write(docs.limit(0), str(tmp_path), token_store.default_vocabulary())).count() == 0


def test_shard_blocks(tmp_path):
    path = str(tmp_path / "x.sst")
    keys = sorted({token_store.key_of((i * 7919) % 100_003 - 50_000) for i in range(5000)})
    with open(path, "wb") as f:
        w = token_store.ShardWriter(f, "<u2")
        for i, k in enumerate(keys):
            w.add(k, np.full(i % 90, i, "<u2").tobytes())
        w.finish()
    shard = token_store.open_shard(path)
    assert len(shard.blocks) > 3 and [k for k, _ in shard] == keys
    assert all(shard.get(k)[0].tolist() == [i] * (i % 90) for i, k in list(enumerate(keys))[::97])
    assert shard.get(token_store.key_of(10**9)) == []


def test_token_query(spark):
    rows = token_store.op6_token_store(spark, MIDDLE).orderBy("doc_id").collect()
    t = token_store.encoder(token_store.default_vocabulary()).tokenizer
    start = 0
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").collect()
    assert len(rows) == len(docs)
    for r, d in zip(rows, docs):
        ids = [*t.encode(d.text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_quality(spark):
    out = quality.op10_quality(spark, MIDDLE)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.toPandas().merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = rows[rows.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.93
    docs = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "word " * 200_000, "s"), (1, "word", "s"), (1, "word", "s")], "doc_id long, text string, score string")
    model = quality.fit(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and got[0].score == got[1].score
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.good(docs, none).columns == docs.columns and quality.good(docs.limit(0), none).count() == 0


def test_quality_reads_unspaced_texts_to_their_end(spark, monkeypatch):
    rng = np.random.default_rng(5)
    same = "文" * 64  # the texts differ only after it
    unspaced = lambda letters, n=300: same + "".join(rng.choice(list(letters), n))
    texts = [unspaced(x) for _ in range(60) for x in ("春夏秋冬", "甲乙丙丁")]
    model = quality.train(texts, np.array([1, 0] * 60))
    scores = quality.Scorer(model).scores(pd.Series([unspaced(x) for _ in range(30) for x in ("春夏秋冬", "甲乙丙丁")]))
    assert scores[::2].min() > 0.6 and scores[1::2].max() < 0.4
    # pieces have the features of the whole word
    monkeypatch.setattr(quality, "PIECE", 7)
    for w in ("春夏" * 50, "a" * 65, "abc" * 7):
        pieces = np.concatenate(list(quality.long_features(w, 1 << 17)))
        assert sorted(pieces.tolist()) == sorted(quality.features([w], 1 << 17)[1].tolist())
    # long words among short ones, repeated and in several batches
    scorer = quality.Scorer(model)
    mixed = ["甲" * 70 + " b " + "甲" * 70 + " " + "甲" * 70, "b", None, "甲" * 70]
    at = [np.concatenate([quality.features([w], len(model.slots))[1] for w in (t or "").split()] or [np.zeros(0, int)]) for t in mixed]
    again = [quality.REPEAT_TIMES, 0, 0, 0]
    want = [(model.slots[x].sum(dtype=float) + r * float(model.slots[quality.REPEAT])) / (len(x) + r + quality.EMPTY) for x, r in zip(at, again, strict=True)]
    for _ in range(2):
        assert scorer.scores(pd.Series(mixed)) == pytest.approx(1 / (1 + np.exp(-(np.array(want) + model.bias))))
    assert set(scorer.known) == {"b"}


def test_quality_does_not_see_held_out_labels(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "quality")
    other = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 0).otherwise(quality.F.col("quality")))
    assert (quality.fit(docs, labels).slots == quality.fit(docs, other).slots).all()


def test_toxicity(spark):
    large = "/root/testdata/sf0.1"  # the smaller ones have too few toxic texts to learn from half of them
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    links = toxicity.fit(docs, half)
    rows = toxicity.score(docs, links).toPandas().merge(labels.toPandas(), on="doc_id")
    rows = rows[rows.doc_id % 2 == 1]
    assert (rows.p_toxic[rows.toxic == 1] >= 0.5).mean() > 0.8 and (rows.p_toxic[rows.toxic == 0] >= 0.5).mean() < 0.02
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "x " * 10_000, 1)], "doc_id long, text string, p_toxic int")
    assert toxicity.score(odd, links).count() == 3
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, none).where("p_toxic > 0.01").count() == 0
    assert toxicity.op8_toxicity(spark, MIDDLE).count() == 1000


def test_chain_uses_earlier_predictions():
    rng = np.random.default_rng(0)
    texts = [f"w{rng.integers(3)} f{rng.integers(50)}" for _ in range(2000)]
    first = np.array([t.startswith("w1") for t in texts], dtype=int)
    links = toxicity.train(texts, np.column_stack([first, first]))
    assert links[1].earlier[0] > 0


def plain_quality(model, text):
    """A text's score, feature by feature."""
    words, own, total, n = (text or "").split(), len(model.slots) - 1, 0.0, quality.EMPTY
    for k, w in enumerate(words):
        data = f"<{w}>".encode()
        slots = [zlib.crc32(w.encode()) % own + 1]
        for size in (2, 3, 4):
            for i in range(len(data) - size + 1):
                gram = size
                for c in data[i : i + size]:
                    gram = (gram << 8 | c) & (1 << 64) - 1
                slots.append((gram * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % own + 1)
        if k and words[k - 1] == w:
            slots += [0] * quality.REPEAT_TIMES
        total += sum(float(model.slots[s]) for s in slots)
        n += len(slots)
    return 1 / (1 + math.exp(-max(-40, min(40, total / n + model.bias))))


def test_quality_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(60).collect()
    texts = [None, "", "a a a", "x" * 70_000, "é" * 100 + " short", *[d.text for d in docs]]
    model = quality.fit(spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet"), most=100)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in quality.score(rows, model).collect():
        assert r.score == pytest.approx(plain_quality(model, texts[r.k]), abs=1e-6)


def test_labels_other_than_zero_and_one(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "%%% bad") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, (k % 2) if k < 30 else 7, None if k > 20 else 3 if k == 5 else k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scores = {r.doc_id % 2: r.score for r in quality.score(docs, model).collect()}
    assert scores[0] < scores[1]
    links = toxicity.fit(docs, labels)
    assert toxicity.score(docs, links).count() == 40 and toxicity.score(docs.limit(0), links).count() == 0


def test_toxicity_by_brute_force(spark):
    """Every probability from the links' weights, word by word."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    links = toxicity.fit(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    rows = docs.limit(80).collect()
    got = {r.doc_id: r for r in toxicity.score(docs, links).collect()}
    for d in rows:
        slots = {zlib.crc32(w.encode()) % toxicity.SLOTS for w in re.findall(r"[^\W\d_]+|[^\w\s]+", (d.text or "").lower())}
        before = []
        for link in links:
            z = sum(float(link.weights[s]) for s in slots) + sum(b * e for b, e in zip(before, link.earlier, strict=True)) + link.bias
            before.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        assert (got[d.doc_id].p_not_quality, got[d.doc_id].p_toxic) == pytest.approx(before, abs=1e-9)
