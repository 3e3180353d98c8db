"""Similar pairs of texts: what travels, and all pairs against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseworks.operators import search, wordsets


def shuffled(spark) -> int:
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def jaccard(sets: list[set], threshold: float) -> dict:
    of = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b]}
    return {k: round(v, 6) for k, v in of.items() if v > threshold}


def test_near_copies_travel_as_texts_and_not_as_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8))
    common = [word() for _ in range(600)]
    texts = [" ".join(common[:k] + [word()] + common[k + 1 :]) for k in range(200)]  # 19,900 pairs
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    before = shuffled(spark)
    monkeypatch.setattr(wordsets, "few", lambda df, _: df)  # as for large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = search.similar_pairs(df, "i", "t").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.a, r.b): round(r.similarity, 6) for r in got} == jaccard([set(t.split()) for t in texts], 0.6) and len(got) == 19_900
    assert shuffled(spark) - before < 10 * sum(map(len, texts))  # each pair with both of its texts is 200 times all texts


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.95])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(wordsets, "PAIRS", 50)  # pairs in many runs,
    monkeypatch.setattr(wordsets, "BLOCK_WORDS", 500)  # sets in many blocks,
    monkeypatch.setattr(wordsets, "KEPT", 100)  # some of them twice,
    monkeypatch.setattr(wordsets, "STRIP_WORDS", 40)  # words in many strips,
    monkeypatch.setattr(wordsets, "TILE_PAIRS", 60)  # and tiles dealt anew
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(600)]
    texts = [" ".join(vocabulary[int(k)] for k in rng.zipf(1.3, n) % 600) for n in rng.integers(1, 60, 60).tolist() + rng.integers(150, 900, 20).tolist()]
    for t in list(texts[20:]):  # near copies, longer and shorter ones among them
        own = t.split()
        texts += [" ".join(w for w in own if rng.random() > 0.15), " ".join([*own, *rng.choice(vocabulary, max(1, len(own) // 3))])]
    texts += [texts[70].upper(), texts[70], "", None, "?", "one", "One!", "ONE two"]
    df = spark.createDataFrame([*enumerate(texts), (None, "one")], "i int, t string")
    sets = [{w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()} for t in texts]
    got = search.similar_pairs(df, "i", "t", threshold).collect()
    assert {(r.a, r.b): round(r.similarity, 6) for r in got} == jaccard(sets, threshold) and len({(r.a, r.b) for r in got}) == len(got)


def test_no_set_without_words_or_pairs(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b"), (4, "c")], "i int, t string")
    assert search.similar_pairs(df, "i", "t").count() == 0
    assert search.similar_pairs(df.where(F.col("i") < 3), "i", "t").count() == 0
