"""Collocations, toxicity and ranked search against brute force and held-out accuracy, with odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseworks.llm import bytewords, collocations, common, decontaminate, minhash, ranked, repeats, toxicity, transducer, warc



SF = "/root/testdata/sf0.001"


# words ------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB9é \t\n-", max_size=12), max_size=6), st.integers(1, 9))
def test_words_are_those_of_the_pattern(texts, at_once):
    before, bytewords.AT_ONCE = bytewords.AT_ONCE, at_once
    try:
        cut = bytewords.words(texts, ranked.OUTSIDE, b" ")
    finally:
        bytewords.AT_ONCE = before
    want = [[w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").replace("B", "b"))] for t in texts]
    flat = [w.encode() for x in want for w in x]
    assert cut.sizes.tolist() == [len(x) for x in want]
    assert [cut.word(i) for i in range(len(cut.start))] == flat
    assert len(set(cut.hash.tolist())) == len(set(flat))


def test_parts_cover_all_texts():
    assert bytewords.parts(["ab", None, "x" * 50, "", "c"], 2, 10) == [(0, 2), (2, 3), (3, 5)]
    assert bytewords.parts([], 2, 10) == []


# 11 ---------------------------------------------------------------------------------------------------------------

phrases = st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=3), st.integers(1, 3)), max_size=30)


def _matrix(data):
    out = np.zeros((len(data), 3), np.uint64)
    for i, (p, _) in enumerate(data):
        out[i, : len(p)] = p
    return out, np.array([n for _, n in data], np.int64)


def _dict(words, found):
    held, counts = found
    return {tuple(int(words[i - 1]) for i in p if i): int(c) for p, c in zip(held, counts, strict=True)}


@settings(max_examples=200, deadline=None)
@given(phrases, phrases)
def test_transducers(one, two):
    of = lambda data: sum((Counter({tuple(p): n}) for p, n in data), Counter())
    a, b = (transducer.Transducer.load(transducer.of_phrases(*_matrix(x)).dump()) for x in (one, two))
    assert _dict(a.words, a.paths(3)) == dict(of(one))
    both = transducer.union([a, b], 3, 2)
    assert _dict(both.words, both.paths(3)) == {p: n for p, n in (of(one) + of(two)).items() if n >= 2}
    assert _dict(a.words, transducer.compose(a, b, 3)) == {p: of(two)[p] for p in of(one) if p in of(two)}


def test_equal_states_are_one():
    t = transducer.of_phrases(np.array([[1, 3, 4], [2, 3, 4], [1, 3, 5], [2, 3, 5]], np.uint64), np.ones(4, np.int64))
    assert len(t.weight) == 4 and len(t.label) == 5


def brute_collocations(data):
    f, n = Counter(), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    gone = set()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            gone |= {(lang, p[i : i + m]) for i in range(len(p) - m + 1) if 100 * a >= 80 * cand[lang, p[i : i + m]]}
    out = []
    for lang in n:
        best = []
        for (own, p), a in cand.items():
            if own == lang and (own, p) not in gone:
                score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:2000])]
    return sorted(out)


@pytest.mark.parametrize("block_docs", [3, 4000])
def test_collocations(spark, monkeypatch, block_docs):
    rng = np.random.default_rng(1)
    words = ["new", "York", "is", "a", "the", "été", "x\x00y", "big", "b\x0bc"]
    data = [(" ".join(rng.choice(words, 40)) + rng.choice([". the new York", ", a big\tbig", "!"]), str(rng.choice(["en", "fr", "a b"]))) for _ in range(90)]
    data += [(None, "en"), ("", "zz"), ("new york. " * 40, None), ("new york. " * 40, "und"), ("A A A A A A " * 30, "en")] + [("of the same kind of words", "en")] * 35
    monkeypatch.setattr(collocations, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(collocations, "RANGE_BYTES", 2000)
    df = spark.createDataFrame([(t, x, i, "s") for i, (t, x) in enumerate(data)], "text string, lang string, doc_id long, at string")
    got = sorted(tuple(r) for r in collocations.collocations(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_collocations(data)
    assert collocations.collocations(df.where("doc_id < 0")).count() == 0 == collocations.collocations(df.where("doc_id < 2")).count()


def test_collocation_scores_pass_64_bits(spark):
    big = 9 * 10**17
    f = spark.createDataFrame([(1, 2, 0, 0, big, 2, big, False), (1, 2, 0, 0, big, 3, big + 5, False)], collocations.PARTS)
    assert collocations._scored(f).first().score == 2000000 * big // (2 * big + 5)


# 12 ---------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    one = got["toxic"] == 1
    place = got["score"].rank()
    auc = (place[one].mean() - (one.sum() + 1) / 2) / (~one).sum()
    assert auc > 0.97 and got["predicted"][one].mean() > 0.8 and got["predicted"][~one].mean() < 0.01


def test_log_ratios_by_hand(spark):
    data = [("bad word here", 1), ("bad thing", 1), ("good word", 0), ("good thing", 0), ("", 0), ("fine bad", 0)]
    df = spark.createDataFrame(data, "text string, label int")
    counts, zeros, ones = toxicity.label_counts(df)
    assert (zeros, ones) == (4, 2)
    base, s = 2 / 6, toxicity.SMOOTH
    ratios = toxicity.log_ratios(counts, zeros, ones)
    for gram, q, p in ((" bad", 1, 2), ("good", 2, 0), ("word", 1, 1), ("zzzz", 0, 0)):
        own = [toxicity.grams(gram)[i] for i in range(len(toxicity.grams(gram)))]
        number = [x for x in own if (counts[:, x] == (q, p)).all()]
        assert number, gram
        assert ratios[number[0]] == pytest.approx(math.log((p + s * base) / (q + s * (1 - base))) - math.log(base / (1 - base)))


def test_features_hold_counts():
    every = np.ones(toxicity.SIZE, bool)
    f, n = toxicity.features("abcd abcd", every)
    assert sorted(toxicity.present("abcd abcd").tolist()) == f.tolist() and n.max() == 2.0
    assert len(toxicity.features("", every)[0]) == 0 == len(toxicity.features(None, every)[0])
    assert toxicity.features("A--B\n\tc d", every)[0].tolist() == toxicity.features("a b c D", every)[0].tolist()


def test_toxicity_odd_rows(spark, tmp_path):
    texts = [(i, f"you are an idiotic {'fool' * (i % 3)} person number {i}" if i % 4 == 0 else f"it was a sunny day number {i}") for i in range(200)]
    docs = spark.createDataFrame([*[(i, t, "x", 1) for i, t in texts], (500, None, "x", 1), (501, "", "x", 1), (None, "you idiotic fool", "x", 1), (8, texts[8][1], "x", 1), (502, "an idiotic fool " * 20000, "x", 1)], "doc_id long, text string, label string, features int")
    labels = spark.createDataFrame([*[(i, int(i % 4 == 0)) for i in range(200)], (0, 0), (3, None), (None, 1), (500, 1)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r for r in got}
    assert of[500].score == of[501].score and of[500].predicted == 0 and of[None].predicted == 1 == of[502].predicted and not of[None].held_out
    assert sum(r.predicted for r in got if r.doc_id is not None and r.doc_id < 200) == 51
    assert of[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    one = toxicity.fit(docs.select("text", F.lit(1).alias("label")))
    assert one.scores(["anything", None]) == pytest.approx([1.0, 1.0])
    assert toxicity.fit(docs.where("doc_id < 0").select("text", F.lit(1).alias("label"))).scores(["x"]) == pytest.approx([0.0])


# 13 ---------------------------------------------------------------------------------------------------------------


def brute_search(docs, queries, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        want = Counter(cut(text))
        best = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in want.items() if c[t])
            if s:
                best.append((-s, i is not None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(best, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize(("shard", "round_bytes"), [(7, 1 << 20), (8192, 60)])
def test_search(spark, monkeypatch, shard, round_bytes):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdé"), 2)) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(150)]
    docs += [(None, "ab AB cd"), (None, "ab AB cd"), (200, None), (201, ""), (202, "--"), (7, docs[7][1]), (203, docs[3][1]), (204, "ab " * 30000)]
    queries = [(f"q{i}", " ".join(rng.choice(words, 6))) for i in range(8)] + [("q0", "ab ab cd"), ("none", "zz9"), ("null", None), ("dash", "-")]
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "STEP", 2)
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, term string")
    q = spark.createDataFrame([(i, t, 9) for i, t in queries], "item_id string, text string, rank int")
    text = lambda found: sorted(tuple(map(str, x)) for x in found)
    got = ranked.search(d, q, round_bytes=round_bytes).select("item_id", "rank", "doc_id", "score")
    assert text(got.collect()) == text(brute_search(docs, queries))
    assert ranked.search(d.where("doc_id < 0"), q).count() == 0 == ranked.search(d, q.where("rank < 0")).count()


def test_search_stops_early():
    """A search over long lists reads the first places only, and an equal score with a smaller doc_id isn't missed."""
    n = 20000
    tf = np.concatenate([np.full(20, 50), np.ones(n - 20)]).astype(np.int64)
    doc = np.tile(np.arange(n, dtype=np.int32), 2)
    s = ranked.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 60), np.repeat(np.arange(2, dtype=np.int32), n), doc, np.tile(tf, 2))
    lists = ranked.Lists(s, ranked.impacts(s, np.array([100, 50]), n, 60 * n), 2)
    docs, scores, read = lists.top(np.array([0, 1]), np.array([1, 1]), 10)
    assert docs.tolist() == list(range(10)) and len(set(scores.tolist())) == 1 and read < 200


# odd rows in the earlier operators and the stages -------------------------------------------------------------------

LONG = "A passage of more than fifty bytes that stands in several of these documents, word for word. "
OWN = [" ".join(f"{w}{k}" for w in ("green", "river", "stone", "cloud", "paper", "glass", "horse", "apple", "music", "light", "bread", "chair")) for k in "abc"]
ODD = [(None, LONG + OWN[0]), (None, "quite another text without any company here"), (1, LONG + OWN[1]), (1, "the second text of the same number, with words of its own"), (2, LONG + OWN[2]), (2, LONG + OWN[2]), (3, None), (4, ""), (None, None)]


def odd_docs(spark):
    names = ["_doc", "_key", "items", "runs", "a", "h", "kind"]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))


def test_no_stage_loses_or_breaks_odd_rows(spark):
    import corpus_pipeline

    docs = odd_docs(spark)
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    every = texts(docs)
    want = {
        "language_id": [x for x in every if x[1]],
        "near_dedup": sorted({(i, t) for i, t in every if t} | {(0, "")}),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert texts(got) == want.get(name, every), name  # equal rows lose the same lines, here none
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_operators_take_rows_without_an_id(spark):
    docs = odd_docs(spark)
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(ODD) and sum(r.doc_id is None for r in got) == 3
    assert {r.n_removed > 0 for r in got if r.doc_id == 2} == {True} and sum(r.n_removed for r in got if r.doc_id is None) == 0
    found = minhash.near_duplicates(common.numbered(docs.select("doc_id", "text"))).withColumn("doc_id", common.real_id()).collect()
    assert len(found) == len(ODD) and sum(r.doc_id is None for r in found) == 3


def test_items_of_any_type(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([("x1", LONG), (None, "quite another text without any company here"), ("x2", None)], "item_id string, text string")
    for size in (1 << 20, 40):
        got = decontaminate.find_contamination(docs, bench, docs.columns, size)
        assert got.columns.count("items") == 1
        by = [(r.text, list(r["items"]), len(r.runs)) for r in got.collect()]
        assert len(by) == len(ODD) and all(x == (["x1"] if t and t.startswith("A passage") else []) for t, x, _ in by)
        assert [n for t, _, n in by if t and t.startswith("quite")] == [1]


def test_archive_of_pages_without_an_id(spark, tmp_path):
    page = "<p>" + "words " * 40 + "</p>"
    data = [(None, "u", page), (None, "v", page), (5, "w", page), (4, None, page), (None, "x", None)]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op2_warc_transactions(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == sorted([(0, "response", 0, 0), (0, "response", 0, 247), (0, "response", 0, 247), (4, "response", 0, 247), (5, "revisit", 4, 247)])
