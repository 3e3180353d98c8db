"""Tests of the fourth round: each failed on the code before it."""

from __future__ import annotations

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from caseworks.llm import leftover
from caseworks.llm import lines as fuzzy
from caseworks.llm.components import components
from caseworks.operators import graph, search
from caseworks.plans import registry
from tests.compare import TABLES, rows, sql_rows

SF = "/root/testdata/sf0.001"


def tables_with(tmp_path, **changed: str) -> str:
    """A folder with the tables of the smallest size, some of them as a SELECT over that size makes them."""
    con = duckdb.connect()
    for t in TABLES:
        if t in changed:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
            con.execute(f"COPY ({changed[t]}) TO '{tmp_path}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def same_as_sql(spark, name: str, at: str) -> int:
    df = registry.queries()[name](spark, at)
    names, want = sql_rows(at, registry.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows(df) == want
    return len(want)


def test_dangling_relations_where_an_order_has_the_number(spark, tmp_path):
    at = tables_with(tmp_path, orders="SELECT * FROM orders UNION ALL SELECT * REPLACE (o_orderkey + 100000 AS o_orderkey) FROM orders")
    assert same_as_sql(spark, "g7_validate_graph", at)


def test_an_end_of_another_type_is_missing(spark):
    nodes = spark.createDataFrame([(1, "a", {"x": "1"}), (2, "b", {"x": "1"})], "id long, type string, properties map<string,string>")
    edges = spark.createDataFrame([(1, "r", 2, "b"), (1, "r", 2, "a")], "src long, rel string, dst long, dst_type string")
    tr = spark.createDataFrame([("a", "x", "required", [])], "type string, field string, rule string, allowed array<string>")
    rr = spark.createDataFrame([("r", [], [], None, True)], "rel string, from_types array<string>, to_types array<string>, max_out int, acyclic boolean")
    assert rows(graph.validate_graph(nodes, edges, tr, rr)) == [("1>r>2", "1", "dangling")]


def test_deviations_of_products_whose_codes_are_cut(spark, tmp_path):
    at = tables_with(tmp_path, part="SELECT * FROM part UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM part")
    assert same_as_sql(spark, "r15_deviations", at)


def test_near_vectors_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 7)
    monkeypatch.setattr(search, "STRIP", 2)
    v = np.random.default_rng(4).normal(size=(40, 3))
    v[5] = 0  # has no direction
    data = [(i % 2, i, [float(x) for x in v[i]]) for i in range(40)]
    unit = {i: v[i] / np.linalg.norm(v[i]) for i in range(40) if i != 5}
    want = {(o, a, b) for o, a, _ in data for p, b, _ in data if o == p and a < b and 5 not in (a, b) and unit[a] @ unit[b] > 0.4}
    df = spark.createDataFrame(data + [(0, 90, None)], "o int, i long, v array<double>")
    got = search.near_dup_vectors(df, "o", "v", "i", 0.4).collect()
    assert len(got) == len(want) and {(r.o, r.a, r.b) for r in got} == want


def test_similar_pairs_compare_only_what_bounds_allow(spark):
    texts = [" ".join([f"own{i}x{k}" for k in range(12)] + [f"all{k}" for k in range(8)]) for i in range(60)]  # 8 of 20 words in common
    texts += [" ".join(f"big{k + 100 * i}" for k in range(900)) for i in range(8)]  # neighbours share 800 of 900
    texts += [texts[3] + " more", "own3x0 " + texts[3]]
    data = [(i, t) for i, t in enumerate(texts)]
    sets = [set(t.split()) for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    want = {k: round(v, 6) for k, v in want.items() if v > 0.6}
    df = spark.createDataFrame(data, "i int, t string")
    got = {(r.a, r.b): round(r.similarity, 6) for r in search.similar_pairs(df, "i", "t").collect()}
    assert got == want
    assert search._close_sets(df.select(F.xxhash64("i").alias("c"), F.split("t", " ").alias("w")), 0.6).count() < 40  # of some 1,800 that share a word of their prefixes


def lost(links, buckets: dict, like, ids) -> int:
    """Pairs over the threshold that share a bucket and aren't in one component."""
    of = {r.node: r.component for r in links.collect()}
    pairs = {(a, b) for held in buckets.values() for a in held for b in held if a < b}
    return sum(of.get(a, a) != of.get(b, b) and like(a, b) >= 0.8 for a, b in pairs)


def test_no_line_of_a_crowded_bucket_is_lost(spark, monkeypatch):
    monkeypatch.setattr(leftover, "SMALL", 1)  # so nearly every bucket is a large one
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    template = letters(110)  # two near lines each of many that share it, but are less alike
    text = [t for _ in range(250) for own in [letters(34)] for t in (template + own, template + own[:-14] + letters(14))]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    found = fuzzy.document_lines(docs)
    links, _ = fuzzy.similar_lines(found)
    line = {r.id: r.line for r in found.collect()}
    buckets: dict = {}
    for r in fuzzy.band_rows(found).collect():
        buckets.setdefault(r.band, set()).add(r.id)
    runs = {i: {t[k : k + 8] for k in range(len(t) - 7)} for i, t in line.items()}
    assert max(map(len, buckets.values())) > 50
    assert lost(components(links, "id", "leader"), buckets, lambda a, b: len(runs[a] & runs[b]) / len(runs[a] | runs[b]), line) == 0


def test_prefix_pairs_of_weighted_sets(spark):
    rng = np.random.default_rng(2)
    sets = {i: {int(t): float(w) for t, w in zip(rng.integers(0, 60, 12), rng.uniform(0.5, 3, 12), strict=True)} for i in range(60)}
    for i in range(0, 60, 3):  # near ones, by a token or by weights
        sets[i + 100] = {t: w * float(rng.uniform(0.9, 1.1)) for t, w in list(sets[i].items())[1:]}

    def like(a, b):
        both = sum(min(w, sets[b].get(t, 0)) for t, w in sets[a].items())
        return both / (sum(sets[a].values()) + sum(sets[b].values()) - both)

    want = {(b, a) for a in sets for b in sets if a < b and like(a, b) >= 0.8}
    made_of = spark.createDataFrame([(i, t, w) for i, own in sets.items() for t, w in own.items()], "id long, token long, weight double")
    got = {(r.member, r.leader) for r in leftover._prefix_pairs(spark.createDataFrame([(i, i) for i in sets], "id long, c long"), made_of, 0.8).collect()}
    assert want and want <= got
