"""Similar texts by the ratio of longest matching blocks, for any script: texts are blocked by characters or by pairs of
them, never by words.

The ratio is 2 M / (la + lb) for M characters in matching blocks. M is at most the number of characters that both texts
hold, repeats counted. Between two blocks stands an unmatched character, so there are at most 1 + la + lb - 2 M blocks, and
the texts share at least 3 M - (la + lb) - 1 pairs of neighbours. So a ratio over t needs more than t / 2 of la + lb
characters in common, and more than (1.5 t - 1) (la + lb) - 1 pairs: an exact bound on pairs for t over 2/3, on characters
for any t. Two texts that share so many tokens share one among the rarest of each (prefix filter), and only texts that do are
compared.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.operators.search import _longest_common, _masks


def gram_size(threshold: float) -> int:
    """Characters of a blocking token: two where the bound on pairs holds even for short texts, else one."""
    return 2 if 1.5 * threshold - 1 > 0.1 else 1


def _needed(length: int, threshold: float, gram: int) -> int:
    """Tokens that a text of a length shares with any text of a ratio over the threshold: the shortest such text bounds it."""
    both = length * 2 / (2 - threshold)  # la + lb for the shortest lb
    bound = threshold / 2 * both if gram == 1 else (1.5 * threshold - 1) * both - 1
    return max(0, math.ceil(bound - 1e-9))


def _tokens(text: str, gram: int) -> list[str]:
    """Runs of `gram` characters, a repeated one told apart by its number."""
    seen: Counter = Counter()
    out = []
    for i in range(len(text) - gram + 1):
        g = text[i : i + gram]
        out.append(f"{g}{seen[g]}")
        seen[g] += 1
    return out


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """The ratio of longest matching blocks; 0 without comparing where a bound shows that it isn't over `least`."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) <= least * total or 2 * sum((Counter(a) & Counter(b)).values()) <= least * total or 2 * _longest_common(_masks(a), len(a), b) <= least * total:
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def near_texts(df: DataFrame, id: str, text: str, threshold: float = 0.6) -> DataFrame:
    """a < b, similarity: each pair of texts whose ratio (of the text of a against that of b, in lower case) is over the
    threshold. Exact. Null and empty texts are like none; equal texts are pairs of similarity 1."""
    gram = gram_size(threshold)
    rows = df.where(F.col(id).isNotNull() & (F.length(text) > 0)).select(F.col(id).alias("i"), F.lower(text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_tokens(t, gram) for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "n": pdf["t"].str.len().astype("int32"), "need": [_needed(len(t), threshold, gram) for t in pdf["t"]], "tokens": found}).astype({"need": "int32"})

    cut = rows.mapInPandas(split, f"i {kind}, n int, need int, tokens array<string>")
    each = cut.select("i", "n", "need", F.explode("tokens").alias("t"))
    freq = each.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")  # a token of one text pairs nothing, but counts as its rarest
    ranked = each.join(freq, "t", "left").groupBy("i", "n", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "t"))).alias("o"))
    prefix = ranked.select("i", "n", F.explode(F.slice("o", 1, F.greatest(F.lit(1), F.size("o") - F.greatest("need", F.lit(1)) + 1))).alias("p")).where("p.f > 1").select("i", "n", F.col("p.t").alias("t"))
    a, b = prefix.select(F.col("i").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("i").alias("b"), F.col("n").alias("nb"), "t")
    close = 2 * F.least("na", "nb") > threshold * (F.col("na") + F.col("nb"))
    cand = a.join(b, "t").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    if gram == 2:  # texts too short for the bound, and so without tokens that they must share, meet by their lengths and characters
        short = rows.where(F.length("t") <= _free(threshold))
        one = short.select("i", F.explode(F.array_distinct(F.split("t", ""))).alias("c")).where("c <> ''")
        x, y = one.select(F.col("i").alias("a"), "c"), one.select(F.col("i").alias("b"), "c")
        cand = cand.unionByName(x.join(y, "c").where("a < b").select("a", "b")).distinct()
    texts = lambda end, name: rows.select(F.col("i").alias(end), F.col("t").alias(name))
    pairs = cand.join(texts("a", "x"), "a").join(texts("b", "y"), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [ratio(x, y, threshold) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf[["a", "b"]].assign(similarity=found)

    return pairs.mapInPandas(compare, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") > threshold)


def _free(threshold: float) -> int:
    """The length up to which a text may be like another without a pair of neighbours in common."""
    n = 1
    while _needed(n + 1, threshold, 2) < 1:
        n += 1
    return n
