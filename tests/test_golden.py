"""Hand-computed results of the operators' traps."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from caseworks.functions import clean, signals
from caseworks.operators import closetext, enrich, graph, intervals, postings, retention, rules, search, stats, tables, textsplit, trends, vectors


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_ratings_and_causes(spark):
    df = spark.createDataFrame([("thumbs_up",), ("thumbs_down",), ("4",), ("x",), (None,)], "r string")
    assert [r.v for r in df.select(signals.rating_value("r").alias("v")).collect()] == [5, 1, 4, 3, 3]
    runs = spark.createDataFrame([(True, None, 1.0), (False, "Key not found", 1.0), (False, "not found: error", 1.0), (False, "error", 301.0), (False, "?", 2.0)], "s boolean, e string, t double")
    assert [r.c for r in runs.select(signals.root_cause("s", "e", "t").alias("c")).collect()] == ["success_pattern", "knowledge_gap", "skill_defect", "resource_limit", "unknown"]


def test_delivery_metrics(spark):
    d = dt.date
    rows = [(d(2026, 2, 10), d(2026, 2, 5), None, "x"), (d(2026, 2, 10), None, None, "x"), (None, d(2026, 2, 5), None, "x"), (d(2026, 2, 5), d(2026, 2, 5), None, "x"), (d(2026, 3, 1), d(2026, 2, 27), None, "x"), (d(2026, 2, 25), d(2026, 2, 1), None, "x")]
    got = signals.delivery_metrics(spark.createDataFrame(rows, "est date, base date, act date, status string"), "est", "base", "act", "status", "abnormal")
    out = [(r.plan_days, r.plan_label, r.plan_cross, r.plan_penalty) for r in got.collect()]
    assert out == [(5, "late", "no", 0.5), (None, "missing", "skip", 0.0), (None, None, "skip", 0.0), (0, "same", "no", 0.5), (2, "late", "yes", 1.0), (24, "late", "no", 1.0)]


def test_prices_and_tokens(spark):
    u = spark.createDataFrame([("a", "m", 1000, 500), ("b", "?", 1000, 1000)], "id string, model string, prompt_tokens long, completion_tokens long")
    p = spark.createDataFrame([("m", "0.03", "0.06")], "model string, input_price string, output_price string")
    got = {r.id: (float(r.input_cost), float(r.output_cost), float(r.cost)) for r in enrich.price_usage(u, p).collect()}
    assert got == {"a": (0.03, 0.03, 0.06), "b": (0.002, 0.004, 0.006)}
    assert [one(spark, clean.estimate_tokens(F.lit(t))) for t in ("", "abcd")] == [0, 3]


def test_masks(spark):
    df = spark.createDataFrame([("A", "13900001234", "ab@x.org"), ("Ann", "12-3", "abcd@x.org")], "name string, phone string, mail string")
    got = clean.mask_pii(df, {"name": "name", "phone": "phone", "mail": "mail"}).collect()
    assert [tuple(r) for r in got] == [("A", "139****1234", "***@x.org"), ("A**", "123", "abc***@x.org")]


def test_clauses_with_header(spark):
    text = "Contract No 7\nParties\n1. First\nmore\n2. Second\nx"
    got = textsplit.split_clauses(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text", [r"^[0-9]+\."]).collect()
    assert [(r.clause_no, r.content) for r in got] == [(1, "Contract No 7\nParties"), (2, "1. First\nmore"), (3, "2. Second")]


def test_chunks_end(spark):
    text = "a" * 600 + ". " + "b" * 500
    got = textsplit.overlap_chunks(text)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(a < b for a, b in got) and all(x[1] > y[0] for x, y in zip(got, got[1:]))


def test_merge_broken_lines(spark):
    text = "The buyer pays\nwithin ten days.\nNext one\n\n# Head\n1. item"
    assert one(spark, clean.merge_broken_lines(F.lit(text), gap=" ")) == "The buyer pays within ten days.\nNext one\n# Head\n1. item"


def test_prune_and_recall_scores(spark):
    now = F.lit("2024-03-31").cast("timestamp")
    m = spark.createDataFrame([(1, "o", 0.5, 50, "2024-02-15"), (2, "o", 0.0, 50, "2024-02-15"), (3, "q", 0.5, 0, "2020-01-01")], "memory_id long, owner string, importance double, accessed_count long, d string").withColumn("ts", F.col("d").cast("timestamp"))
    got = {r.memory_id: r for r in trends.prune_quota(m, spark.createDataFrame([("o", 1), ("q", -1)], "owner string, memory_limit int"), now).collect()}
    assert abs(got[1].prune_score - 0.5) < 1e-9 and abs(got[2].prune_score - 0.5) < 1e-9 and abs(got[3].prune_score - 0.2) < 1e-9
    assert (got[1].pruned, got[2].pruned, got[3].pruned) == (False, True, False)


def test_weighted_classes_strict(spark):
    r = spark.createDataFrame([(1, "top", 9, ["zz"], ["yy"], [], 0), (2, "low", 1, ["pay"], [], [], 0), (3, "no", 9, ["pay"], [], ["pay"], 0)], "seq int, name string, priority int, core array<string>, keywords array<string>, exclude array<string>, early_bonus int")
    c = spark.createDataFrame([(1, 1, "they pay"), (1, 2, "nothing")], "doc_id int, clause_no int, content string")
    assert [x.category for x in rules.classify_weighted(c, r).orderBy("clause_no").collect()] == ["low", "other"]
    assert [x.category for x in rules.classify_weighted(c, r, strict=False).orderBy("clause_no").collect()] == ["top", "top"]


def test_l2_scores(spark):
    v = spark.createDataFrame([(1, [1.0] + [0.0] * 7, "a"), (2, [0.0, 1.0] + [0.0] * 6, "a")], "id long, v array<float>, collection string")
    q = spark.createDataFrame([(9, [0.9, 0.1] + [0.0] * 6)], "query_id long, v array<float>")
    got = search.vector_topk(q, v, 2, "l2").orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and abs(got[0].score - 0.98039) < 1e-4 and abs(got[1].score - 0.38168) < 1e-4


def test_replay_delete_and_revive(spark):
    rows = [(1, "create", 1, "t", {"a": "1"}, None, None, None), (2, "delete", 1, None, None, None, None, None), (3, "update", 1, None, {"a": "2"}, None, None, None), (4, "create", 2, "t", {"a": "1"}, None, None, None), (5, "update", 2, None, {"b": "2"}, None, None, None), (6, "relate", None, None, None, 1, "r", 2), (7, "relate", None, None, None, 2, "r", 1), (8, "unrelate", None, None, None, 2, "r", 1)]
    log = spark.createDataFrame(rows, "seq long, op string, id long, type string, properties map<string,string>, src long, rel string, dst long")
    nodes, edges = graph.replay(log)
    assert [(r.id, r.properties) for r in nodes.collect()] == [(2, {"a": "1", "b": "2"})]
    assert [(r.src, r.dst) for r in edges.collect()] == [(1, 2)]


def test_cascade_only_on_a_drop(spark):
    n = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    e = spark.createDataFrame([(2, "requires", 1), (3, "contains", 1)], "src long, rel string, dst long")
    fell = spark.createDataFrame([(1, 1.0, 0.3)], "id long, old_rate double, new_rate double")
    assert [r.dependent for r in graph.cascade(n, e, fell).collect()] == [2]
    assert graph.cascade(n, e, fell.withColumn("new_rate", F.lit(0.9))).count() == 0


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "src long, dst long")
    assert sorted(r.id for r in graph.cyclic_nodes(e).collect()) == [1, 2, 3]


def test_order_and_partitions_do_not_matter(spark):
    rows = [Row(id=i, title=f"T {i % 7}", k=i) for i in range(50)]
    a = spark.createDataFrame(rows)
    b = spark.createDataFrame(rows[::-1]).repartition(3)
    assert sorted(map(tuple, retention.dedup_title(a, "title", "k").collect())) == sorted(map(tuple, retention.dedup_title(b, "title", "k").collect()))


def test_budget_is_strict(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 1.1), ("c", 9.0)], "k string, cost double")
    got = stats.check_budget(s, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, budget double"), "k")
    assert {r.k: r.over for r in got.collect()} == {"a": False, "b": True, "c": False}


def test_dedup_text_is_plain_sequence_matching(spark):
    from difflib import SequenceMatcher

    texts = ["colour", "colours", "甲方应在十日内付款给乙方", "甲方应在九日内付款给乙方", "teh quikc borwn", "the quick brown", "unlike", "", "soloruc"]
    kept: list[str] = []
    for t in texts:
        if not any(t == k or SequenceMatcher(None, k, t, autojunk=False).ratio() >= 0.8 for k in kept):
            kept.append(t)
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, i long, t string")
    got = search.dedup_text(df, "doc", "t", "i").collect()
    assert sorted(r.i for r in got) == sorted(texts.index(k) for k in kept) and len(kept) < len(texts) - 1


PAGE = """some words first
| Name | Qty | Price |
|:-----|----:|------:|
| Bolt | 3 | 1.50 |

| Nut  | 12 |



┌──────────┬─────┐
│ Item     │ Qty │
├──────────┼─────┤
│ Bolt     │ 3   │
│ Long Nut │     │
└──────────┴─────┘
x
y
z
Name        Qty    Price   Note
Widget A      3    10.50   ok
Gadget             99.00   late item
产品甲         7     1.00   中文
no  table
"""


def test_tables_of_all_kinds(spark):
    data = [(1, PAGE), (2, None), (3, ""), (4, "a  b  c\nd  e  f  g  h\n"), (5, "one  two  three\n\n\nfour  five  six\n\n\n\nseven  eight  nine\nten  to  go"), (6, "a  bb  c\naaaa  b  c  d"), (7, "| a | b |\n| c | d |")]
    df = spark.createDataFrame(data, "id long, text string")
    got = {}
    for r in tables.detect_tables(df, "id", "text").orderBy("id", "table_no", "row_no", "cell_no").collect():
        got.setdefault((r.id, r.table_no, r.kind), {}).setdefault((r.row_no, r.role), []).append(r.cell)
    rows_of = lambda *key: list(got[key].values())
    assert rows_of(1, 1, "pipe") == [["Name", "Qty", "Price"], [":-----", "----:", "------:"], ["Bolt", "3", "1.50"], ["Nut", "12", ""]]
    assert [role for _, role in got[1, 1, "pipe"]] == ["header", "separator", "data", "data"]
    assert rows_of(1, 2, "border") == [["Item", "Qty"], ["Bolt", "3"], ["Long Nut", ""]]
    assert [role for _, role in got[1, 2, "border"]] == ["header", "data", "data"]
    assert rows_of(1, 3, "space") == [["Name", "Qty", "Price", "Note"], ["Widget A", "3", "10.50", "ok"], ["Gadget", "", "99.00", "late item"], ["产品甲", "7", "1.00", "中文"]]
    assert rows_of(5, 1, "space") == [["one", "two", "three"], ["four", "five", "six"]] and rows_of(5, 2, "space") == [["seven", "eight", "nine"], ["ten", "to", "go"]]
    assert rows_of(6, 1, "space") == [["a", "bb", "c", ""], ["aaaa", "b", "c", "d"]]
    assert {k[0] for k in got} <= {1, 4, 5, 6}  # pipes without a separator line are no table
    first = {(r.id, r.region): (r.first, len(r.lines)) for r in tables.table_regions(df, "id", "text").collect()}
    assert first[1, 1] == (1, 5) and first[5, 1] == (0, 4) and (2, 1) not in first


def test_near_dup_hashed(spark):
    """Two thousand unrelated vectors and as many near copies at a cosine of 0.95 to 0.99: recall, exact values, few candidates; the
    same pairs from blocks of a few vectors, and none across owners or lengths."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((2000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((2000, 32))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.99, 2000)[:, None]
    all_ = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * noise]) * 3
    owner = ["x", None] * 2000
    data = [(i, owner[i], v.tolist()) for i, v in enumerate(all_)] + [(9000, "x", [0.0] * 32), (9001, "x", None), (9002, "x", all_[0].tolist()), (9003, "x", [1.0, 2.0]), (9004, "x", [1.0, 2.1]), (None, "x", all_[2].tolist()), (9005, "y", all_[0].tolist())]
    df = spark.createDataFrame(data, "id long, owner string, v array<double>")
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T, 1) > 0.95), strict=True) if owner[a] == owner[b]} | {(9003, 9004)}
    got = {(r.a, r.b): r.similarity for r in vectors.near_dup_hashed(df, "owner", "v", "id", 0.95, 0.95).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    assert all(abs(s - unit[a] @ unit[b]) < 1e-9 for (a, b), s in got.items() if b < 9000)
    rows, members = vectors.distinct_vectors(df, "owner", "v", "id")
    p = vectors.plan(0.95, 0.95, 2000)
    cand = vectors.candidate_pairs(rows, p)
    pairs = sorted((r.a, r.b) for r in cand.collect())
    assert len(pairs) == len(set(pairs)) < 4 * len(want)
    assert sorted((r.a, r.b) for r in vectors.candidate_pairs(rows, p, 5).collect()) == pairs
    assert {r.id: r["class"] for r in members.where("id >= 9000").collect()} == {9002: 0, 9003: 9003, 9004: 9004, 9005: 9005}
    assert vectors.near_dup_hashed(df.where("id < 0"), "owner", "v", "id").count() == 0


def test_interval_joins(spark):
    """Against all pairs: lengths from 1 to millions, touching ends, empty intervals, nulls, other keys, negative places."""
    rng = np.random.default_rng(4)
    starts = rng.integers(-3000, 3000, 300)
    data = [(i, "k" if i % 3 else "z", int(a), int(a) + int(2 ** rng.uniform(0, 12))) for i, a in enumerate(starts)] + [(900, "k", 5, 5), (901, "k", 9, 2), (902, "k", None, 7), (903, None, -9999, 9999), (904, "k", -(10**15), 10**15)]
    iv = spark.createDataFrame(data, "n int, key string, a long, b long")
    points = [(i, str(rng.choice(["k", "z", "y"])), int(x)) for i, x in enumerate(rng.integers(-4000, 8000, 400))] + [(990, None, 3), (991, "k", None)]
    p = spark.createDataFrame(points, "i int, key string, at long")
    inside = {(i, n) for i, key, at in points for n, own, a, b in data if key is not None and key == own and None not in (at, a, b) and a <= at < b}
    got = [(r.i, r.n) for r in intervals.interval_join(p, iv, "key", "at", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == inside
    some = iv.where("n <> 904")
    hit = {i for i, n in inside if n != 904}
    assert sorted(r.i for r in intervals.outside(p, some, "key", "at", "a", "b").collect()) == sorted(i for i, *_ in points if i not in hit)
    assert intervals.outside(p, iv.limit(0), "key", "at", "a", "b").count() == len(points) and intervals.interval_join(p, iv.limit(0), "key", "at", "a", "b").count() == 0


def test_intervals_of_one_key_are_no_product(spark):
    """A hundred thousand intervals and a million points of one key."""
    iv = spark.range(100_000).select(F.lit("k").alias("key"), (F.col("id") * 100).alias("a"), (F.col("id") * 100 + 50).alias("b"))
    p = spark.range(1_000_000).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("at"))
    assert intervals.outside(p, iv, "key", "at", "a", "b").count() == 500_000
    assert intervals.interval_join(p, iv, "key", "at", "a", "b").count() == 500_000


def test_index_blocks(spark):
    ids = [*range(-40, 3000, 3), 10**12]
    df = spark.createDataFrame([(i, "all" + (" Even" if i % 2 == 0 else "") + (" rare, rare!" if i in (-40, 500, 10**12) else "")) for i in ids] + [(8, "all rare"), (8, None), (9, ""), (None, "all rare")], "id long, text string")
    index = postings.index_blocks(df, "id", "text", 100).cache()
    blocks = index.collect()
    assert max(r.n for r in blocks) <= 100 and sum(r.n for r in blocks if r.term == "all") == len(set(ids) | {8})
    own = sorted((r.first, r.last) for r in blocks if r.term == "all")
    assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
    got = {}
    for r in postings.unpack(index).collect():
        got.setdefault(r.term, []).append(r.id)
    assert {t: sorted(x) for t, x in got.items()} == {"all": sorted({*ids, 8}), "even": sorted(i for i in ids if i % 2 == 0), "rare": [-40, 8, 500, 10**12]}
    assert sorted(r.id for r in postings.lookup_all(index, ["rare", "even", "rare"]).collect()) == [-40, 8, 500, 10**12]
    assert postings.lookup_all(index, ["rare", "none"]).count() == 0
    low = postings.index_blocks(df.where("id < 100 OR text LIKE 'all%' AND text NOT LIKE '%rare%'"), "id", "text", 100)
    assert postings.meeting_blocks(low, ["rare", "all"]).where("term = 'all'").count() < low.where("term = 'all'").count()
    assert postings.index_blocks(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_near_texts_of_unspaced_script(spark, threshold):
    """Three hundred Chinese clauses and short texts, many near copies: equal to all pairs."""
    rng = np.random.default_rng(6)
    signs = [chr(0x4E00 + int(x)) for x in rng.integers(0, 400, 120)]
    base = ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(100)]
    texts = list(base)
    for t in base:
        for k in (1, 4):
            cut = list(t)
            for _ in range(k):
                cut[rng.integers(0, len(cut))] = str(rng.choice(signs))
            texts.append("".join(cut) + ("。" if k > 1 else ""))
    texts += ["ab", "AB", "ba", "abc", "", "x"]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "id long, text string")
    low = [t.lower() for t in texts]
    want = {(a, b): closetext.SequenceMatcher(None, low[a], low[b], autojunk=False).ratio() for a in range(len(low)) for b in range(a + 1, len(low)) if low[a] and low[b]}
    want = {p: r for p, r in want.items() if r > threshold}
    assert {(r.a, r.b): r.similarity for r in closetext.near_texts(df, "id", "text", threshold).collect()} == want and len(want) > 40


def test_similarity_by_blocks(spark):
    o = spark.createDataFrame([(1, "pay", "乙方应在三十日内付款"), (1, "ship", "甲方交货")], "doc_id int, type string, content string")
    s = spark.createDataFrame([("pay", "乙方应在十五日内付款"), ("ship", "甲方交货"), ("keep", "保密")], "type string, content string")
    got = {r.type: (r.change, r.similarity) for r in rules.compare_obligations(o, s, "blocks").collect()}
    assert got == {"pay": ("changed", 0.9), "ship": ("same", 1.0), "keep": ("removed", None)}
    skills = spark.createDataFrame([(1, "合同审查", "风险", ["合同"], "production", 0.5), (2, "天气", "", [], "beta", None)], "id int, name string, description string, tags array<string>, maturity string, success_rate double")
    assert [(r.id, round(r.score, 6)) for r in search.rank_skills(skills, "合同审查", measure="blocks").collect()] == [(1, round(0.5 * 8 / 11 + 0.1, 6))]


def test_levels_of_a_long_chain(spark, monkeypatch):
    """A chain of 5,000 in 14 rounds at most, equal to counting; rings, what hangs below them, orphans and repeated items."""
    rounds = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, f=graph.cut_lineage: rounds.append(1) or f(df))
    data = [(i, i - 1 if i else None) for i in range(5000)] + [(6000, 6001), (6001, 6002), (6002, 6000), (6003, 6002), (6004, 6004), (7000, 9999), (7001, 7000), (8000, None), (8001, 8000), (8001, 8000)]
    got = {r.id: (r.level, r.root, r.status) for r in graph.levels(spark.createDataFrame(data, "id long, p long"), "id", "p").collect()}
    assert len(got) == len(data) - 1 and len(rounds) <= 15  # one before the first round
    assert all(got[i] == (i, 0, "tree") for i in range(5000)) and got[8001] == (1, 8000, "tree")
    assert {got[i] for i in (6000, 6001, 6002, 6003, 6004)} == {(None, None, "cycle")} and {got[i] for i in (7000, 7001)} == {(None, None, "orphan")}
    assert graph.levels(spark.createDataFrame([], "id long, p long"), "id", "p").count() == 0


def test_shortest_paths_against_search(spark):
    rng = np.random.default_rng(8)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2))})
    edges = spark.createDataFrame([(a, "r", b) for a, b in pairs], "src long, rel string, dst long").cache()

    def brute(start, end, most):
        ways = [[start]]
        for _ in range(most):
            ways = [w + [b] for w in ways for a, b in pairs if a == w[-1]]
            if hit := [w for w in ways if w[-1] == end]:
                return min(hit)
        return None

    for start, end, most in ((0, 1, 5), (3, 20, 4), (5, 5, 4), (7, 39, 3), (pairs[0][0], pairs[0][1], 1), (99, 1, 4), (1, 99, 3)):
        got = graph.shortest_path(edges, start, end, most).collect()
        want = brute(start, end, most)
        assert [(r.hops, r.path) for r in got] == ([(len(want) - 1, want)] if want else []), (start, end, most)


def test_quota_of_one_large_owner(spark):
    """An owner with nine tenths of the rows, most with equal scores, is pruned like any other, by ranges of the order."""
    data = [(i, "big" if i % 10 else f"o{i % 70}", 0.5 if i % 3 else (i % 100) / 100, i % 5 * 10) for i in range(20000)]
    m = spark.createDataFrame(data, "memory_id long, owner string, importance double, accessed_count int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    q = spark.createDataFrame([("big", 7000), ("o0", -1), ("o10", 0), ("o20", 10**6)], "owner string, memory_limit int")
    got = trends.prune_quota(m, q, F.lit("2024-01-31").cast("timestamp"), 50).collect()
    limit = {"big": 7000, "o0": 10**9, "o10": 0, "o20": 10**6}
    by = {}
    for r in got:
        by.setdefault(r.owner, []).append((-r.prune_score, r.memory_id, r.pruned))
    assert len(got) == 20000 and set(got[0].asDict()) == {*m.columns, "prune_score", "pruned"}
    for owner, rows_ in by.items():
        assert [p for *_, p in sorted(rows_)] == [k >= limit.get(owner, 50) for k in range(len(rows_))], owner
    ranked = trends.rank_within(m, "owner", [F.desc("accessed_count"), F.asc("memory_id")])
    big = sorted((-r.accessed_count, r.memory_id, r.rank) for r in ranked.where("owner = 'big'").collect())
    assert [k for *_, k in big] == list(range(1, len(big) + 1))


def test_rolled_up_sketches(spark):
    rng = np.random.default_rng(9)
    values = rng.lognormal(0, 2, 30000)
    data = [(f"s{i % 2}", f"2024-01-{1 + i % 20:02d}", float(v) if i % 11 else None, f"u{i % 400}", i % 4 > 0) for i, v in enumerate(values)]
    spans = spark.createDataFrame(data, "skill string, ts string, latency double, user_id string, success boolean")
    rows_ = stats.telemetry_sketches(spans, "skill")
    assert rows_.count() == 20 and rows_.agg(F.max(F.length("latencies"))).first()[0] < 20000
    for keys, own in (([], data), (["skill"], [x for x in data if x[0] == "s1"])):
        r = next(x for x in stats.roll_up(rows_, keys).collect() if not keys or x.skill == "s1")
        timed = np.sort([x[2] for x in own if x[2] is not None])
        assert (r.calls, r.successes) == (len(own), sum(x[4] for x in own)) and r.mean == pytest.approx(timed.mean())
        for p, at in ((r.p50, 0.5), (r.p95, 0.95), (r.p99, 0.99)):
            assert abs(np.searchsorted(timed, p) / len(timed) - at) <= stats.RANK_ERROR
        assert abs(r.users - len({x[3] for x in own})) <= 0.05 * 400


def test_jitter_bounds_and_seed(spark):
    df = spark.range(3000).select("id", (F.col("id") + 1).cast("double").alias("Salary_Amount"), F.lit(5.0).alias("other"), F.lit(None).cast("double").alias("amount2"))
    once, again, other = (clean.jitter(df, ["amount"], seed).orderBy("id").collect() for seed in (3, 3, 4))
    factors = np.array([r.Salary_Amount / (r.id + 1) for r in once])
    assert once == again != other and all(r.other == 5.0 and r.amount2 is None for r in once)
    assert factors.min() >= 0.9 and factors.max() <= 1.1 and abs(factors.mean() - 1) < 0.01 and factors.std() > 0.05


def test_sentence_chunks():
    s = textsplit.sentence_chunks
    assert s("One two. Three four! Five?  Six。 Seven", 20, 9) == ["One two. Three four!", "Five? Six。 Seven"]
    assert s("aaaa. bbbb. cccc. dddd.", 11, 5) == ["aaaa. bbbb.", "bbbb. cccc.", "cccc. dddd."]
    assert s("aaaa. bbbb. cccc.", 11, 4) == ["aaaa. bbbb.", "cccc."]
    assert s("x" * 30, 10, 5) == ["x" * 30] and s("", 10, 5) == [] == s("  \n", 10, 5)
