"""Tests of the fifth round: each failed on the code before it."""

from __future__ import annotations

import os
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from caseworks.operators import graph, rules, search, textsplit
from caseworks.sources import io


def matched(spark, docs, products, k=5):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame([(c, n, m, "x" * e) for c, n, m, e in products], "product_code string, product_name string, product_model string, service_description string")
    return {(r.doc_id, r["rank"]): (r.product_code, round(r.score, 9)) for r in rules.match_products(d, p, "PC-[0-9]{3}", 0.6, k).collect()}


def matched_one_by_one(docs, products, k=5):
    out = {}
    for doc, text in docs:
        words, found = set(text.lower().split()), []
        for code, name, model, extra in products:
            share = lambda x: len(set(x.split()) & words) / len(set(x.split()))
            score = share(name) * 0.5 + share(model) * 0.3 + min(extra / 500, 0.2)
            if code in text.upper() or (score >= 0.6 - 1e-12 and set(f"{name} {model}".split()) & words):
                found.append((-round(max(1.0, score) if code in text.upper() else score, 9), code))
        out |= {(doc, i + 1): (code, -score) for i, (score, code) in enumerate(sorted(found)[:k])}
    return out


def test_products_of_equal_scores_by_their_codes(spark):
    """0.25 + 0.15 + 0.2 is over 0.5 + 0.1 in doubles, and the same score."""
    docs, products = [(1, "a b x")], [("PC-001", "a b", "q", 50), ("PC-002", "a c", "x y", 100)]
    assert matched(spark, docs, products) == {(1, 1): ("PC-001", 0.6), (1, 2): ("PC-002", 0.6)} == matched_one_by_one(docs, products)


def test_products_against_one_by_one(spark):
    rnd = random.Random(5)
    words, models = [f"w{i}" for i in range(7)], ["w0", "m1", "m2", "m3 m4", "m4 w1"]
    products = [(f"PC-{i:03}", " ".join(rnd.sample(words, rnd.randint(1, 3))), rnd.choice(models), rnd.choice([0, 40, 70, 100, 300])) for i in range(150)]
    docs = [(i, " ".join(rnd.sample([*words, "m1", "m2", "m3", "m4", "pc-017", "x"], rnd.randint(0, 8)))) for i in range(120)]
    for k in (2, 5):
        got = matched(spark, docs, products, k)
        assert got == matched_one_by_one(docs, products, k) and len(got) > 100


def test_dedup_text_with_cells_of_several_letters(spark, monkeypatch):
    monkeypatch.setattr(search, "LETTER_CELLS", 3)
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdé甲") for _ in range(rnd.randint(3, 12))) for _ in range(40)]
    texts += [t[:-1] + rnd.choice("ab") + "c" * rnd.randint(0, 1) for t in texts[:25]] + texts[5:9]
    kept: list[list] = []
    for i, t in enumerate(texts):
        like = next((k for k in kept if t == k[3] or SequenceMatcher(None, k[3], t, autojunk=False).ratio() >= 0.8), None)
        if like is None:
            kept.append([i, t, 0, t])
        else:
            like[1], like[2] = max(like[1], t, key=len), like[2] + 1
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, i long, t string")
    assert sorted((r.i, r.t, r.n_merged) for r in search.dedup_text(df, "doc", "t", "i").collect()) == [tuple(k[:3]) for k in kept]


def test_tag_pairs_are_dealt_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_PAIRS", 10)
    rnd = random.Random(3)
    tags = {i: sorted(rnd.sample("abcdefgh", rnd.randint(1, 5))) for i in range(20)}
    got = search.tag_pairs(spark.createDataFrame(list(tags.items()), "i long, tags array<string>"), "i", "tags")
    want = {(a, b): sorted(set(tags[a]) & set(tags[b])) for a in tags for b in tags if a < b and len(set(tags[a]) & set(tags[b])) > 1}
    assert {(r.a, r.b): r.shared for r in got.collect()} == want
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()


def test_documents_are_files_of_one_folder_from_several_tasks(spark, tmp_path):
    at = str(tmp_path / "docs")
    io.write_documents(spark.range(40).select("id", F.concat(F.lit("text "), "id").alias("value")), f"file://{at}", "id")
    files = [x for x in os.listdir(at) if x.endswith(".txt")]
    assert len(files) == 40 and len({x.split("-")[1] for x in files}) == 4
    assert {r.content.strip() for r in io.read_documents(spark, f"file://{at}").collect()} == {f"text {i}" for i in range(40)}


def test_chunks_go_out_by_characters(spark, monkeypatch):
    monkeypatch.setattr(textsplit, "CHUNKED_CHARS", 700)
    texts = {i: " ".join(f"Sentence {i} {j} of a text." for j in range(i * 7 % 60)) or None for i in range(30)}
    got = textsplit.chunk_sentences(spark.createDataFrame(list(texts.items()), "i long, t string"), "i", "t").collect()
    assert {(r.i, r.chunk_index): r.chunk for r in got} == {(i, k): c for i, t in texts.items() for k, c in enumerate(textsplit.sentence_chunks(t or ""))}


def test_small_layers_of_repeated_edges_are_broadcast(spark, monkeypatch):
    sizes, few = [], graph.few
    monkeypatch.setattr(graph, "few", lambda df: sizes.append(df.count()) or few(df))
    edges = spark.createDataFrame([(a, "r", b) for a, b in ((0, 3), (0, 2), (2, 9), (3, 9), (9, 5)) for _ in range(3)], "src long, rel string, dst long")
    assert [(r.hops, r.path) for r in graph.shortest_path(edges, 0, 5, 4).collect()] == [(3, [0, 2, 9, 5])]
    assert sizes and max(sizes) <= 2


def test_best_vectors_in_strips_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES", 50)
    v = np.random.default_rng(4).normal(size=(60, 5)).round(3)
    rows = spark.createDataFrame([(i, x.tolist(), f"g{i % 3}") for i, x in enumerate(v)], "id long, v array<double>, collection string")
    queries = rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), "v")
    for metric in ("l2", "cosine"):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        score = (lambda a, b: 1 / (1 + ((v[a] - v[b]) ** 2).sum())) if metric == "l2" else (lambda a, b: unit[a] @ unit[b])
        got = {(r.query_id, r["rank"]): r.id for r in search.vector_topk(queries, rows, 3, metric).collect()}
        assert got == {(a, k + 1): b for a in range(0, 60, 4) for k, b in enumerate(sorted(range(60), key=lambda b: (-round(score(a, b), 9), b))[:3])}
