"""Metadata, quality, tables and blocks of an index, against plain forms."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from caseworks.functions import clean, extract
from caseworks.operators import graph, postings, tables

WORDS = r"(?<![A-Za-z0-9_])([a-z]{4,})(?![A-Za-z0-9_])"


def _keywords(texts):
    counts = Counter(w for t in texts for w in re.findall(WORDS, t.lower()))
    return sorted(counts, key=lambda w: (-counts[w], w))[:5]


def test_blocks_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(postings, "DEALT_IDS", 50)
    docs = [(i, "all " + ("even" if i % 2 == 0 else "odd")) for i in range(-7, 400)]
    rows = spark.createDataFrame([*docs, *docs[::3], (None, "all")], "id long, text string")
    index = postings.index_blocks(rows, "id", "text", 8)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange") == 1
    blocks = index.collect()
    assert max(r.n for r in blocks) == 8
    held = sorted((r.term, int(i)) for r in blocks for i in postings._decoded(r["first"], r.width, r.gaps))
    assert held == sorted({(w, i) for i, t in docs for w in t.split()})
    assert sorted(r.id for r in postings.lookup_all(index, ["all", "odd"]).collect()) == [i for i, t in docs if "odd" in t]


def test_border_patterns_take_runs_at_once(spark):
    text = "┌────┬────┐\n│ ab ┼ │ c  d │\n├────┼────┤\n│ efgh │ │\n└────┴────┘"
    rows = tables.detect_tables(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("row_no", "cell_no").collect()
    assert [(r.kind, r.row_no, r.role, r.cell) for r in rows] == [("border", 1, "header", "ab"), ("border", 1, "header", "c d"), ("border", 2, "data", "efgh"), ("border", 2, "data", "")]
    counted = spark.range(1).select(tables._count(F.lit("──a─|--"), tables.HORIZONTAL).alias("n")).first().n
    assert counted == 5


def test_keywords_of_single_and_repeated_ids(spark):
    rows = [(1, "Beta alpha beta gamma delta eps1 omega theta gamma zeta"), (2, ""), (3, None), (None, "alpha beta"), (4, "one two")]
    single = spark.createDataFrame(rows, "id long, text string")
    found = extract.text_metadata(single, "id", "text")
    assert {r.id: r.keywords for r in found.collect()} == {1: _keywords([rows[0][1]]), 2: [], 3: [], None: [], 4: []}
    assert "Exchange" not in found.select("id", "keywords")._jdf.queryExecution().executedPlan().toString()
    twice = single.unionByName(spark.createDataFrame([(1, "theta theta theta")], "id long, text string"))
    found = extract.text_metadata(twice, "id", "text").where("id = 1").collect()
    assert [r.keywords for r in found] == [_keywords([rows[0][1], "theta theta theta"])] * 2


def test_odd_characters_are_counted_as_by_the_plain_classes(spark):
    text = "".join(map(chr, [*range(0x20, 0x2400), *range(0x2400, 0x2700), 0xFFFE, 0x1F600])) + "\t\n@@©®™─☆ "
    assert len(re.findall(clean.GARBAGE, text)) > 30
    one = spark.createDataFrame([(text,)], "text string")
    solid = F.regexp_replace("text", r"\s", "")
    n, g = F.length(solid), F.regexp_count(solid, F.lit(clean.GARBAGE))
    bad = F.regexp_count(solid, F.lit(r"[^\p{L}\p{N}\p{P}\p{S}\p{M}]"))
    want = one.select(((n - g - bad) / n * (1 - g / n * 0.5)).alias("x"), F.regexp_count("text", F.lit(clean.BORDER)).alias("b"), g.alias("g")).first()
    assert clean.text_quality(one, "text").first().char_ratio == want.x
    got = one.select(F.regexp_count("text", F.lit(clean._BORDER)).alias("b"), F.regexp_count("text", F.lit(clean._GARBAGE)).alias("g")).first()
    assert (got.b, got.g) == (want.b, want.g)


def test_levels_write_their_rounds_as_files(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut_lineage", None)
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(50, 99), (60, 61), (61, 60), (62, 61)]
    found = graph.levels(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()
    want = {(i, i, 0, "tree") for i in range(40)} | {(50, None, None, "orphan")} | {(i, None, None, "cycle") for i in (60, 61, 62)}
    assert {(r.id, r.level, r.root, r.status) for r in found} == want
