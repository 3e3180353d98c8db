"""Ranked lexical search by the Best Position Algorithm over impact lists.

1. Shards: what a task reads in a row (SHARD_DOCS documents and SHARD_CHARS characters at most) is cut into terms, and keeps
   the postings of the terms that the queries hold, as one row. No text is shuffled. N, L and df are sums over the shards.
2. In a shard each query term has an impact list: its documents by falling share of the score (equal ones by doc_id), with
   the place of each document in it. The algorithm reads all lists side by side; each document that it meets for the first
   time is looked up in every list (direct access), which gives its exact score and marks its place there as seen. A list's
   best position is the end of its run of seen places without a gap. An unseen document stands behind it in every list, so
   its score is at most the sum of the impacts at the first unseen places. A search stops as soon as that threshold is
   strictly below the k-th best score (an equal score might win by its doc_id), or is 0.
3. The shards' k best meet per query, k rows a shard at most, and the k best of these are the result: the same rows for
   any division into shards.

Queries are collected in rounds of ROUND_BYTES of text, each of which scans the documents once.

Defined results: null texts and texts without a term count nowhere and are never found; queries without a term, or whose
terms no document holds, give no rows; a term's repeats in the query count as often; equal scores go by doc_id, a null one
first, and repeated rows of one doc_id each have a rank; every row of the benchmark is a query of its own, whatever its
item_id; extra columns are ignored; an empty table gives no rows. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseworks.llm.bytewords import byte_class, parts, words
from caseworks.llm.common import materialize, table

K = 10
SHARD_DOCS = 8192
SHARD_CHARS = 32 << 20
#: Bytes of query text of a round; its terms, some 20,000, are what the tasks of a round get.
ROUND_BYTES = 1 << 20
#: Places that are read of each list at first; the number doubles up to the second.
STEP, MOST = 16, 512
#: Bytes between terms: all of ASCII but digits and letters.
OUTSIDE = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass
class Shard:
    """Documents by doc_id, and the postings of each query term."""

    doc_id: np.ndarray
    null: np.ndarray
    #: Terms of each document.
    n: np.ndarray
    #: Number of the query term, of the document, and its occurrences there; in the order of terms.
    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


def shard(ids: pd.Series, texts: list[str | None], terms: np.ndarray) -> Shard:
    """The shard of some documents for sorted hashes of query terms. Documents without a term are left out."""
    cut = words(texts, OUTSIDE, b" ")
    null = ids.isna().to_numpy()
    doc_id = ids.fillna(0).to_numpy(np.int64)
    order = np.lexsort((doc_id, ~null))
    order = order[cut.sizes[order] > 0]
    place = np.full(len(texts), -1, np.int64)
    place[order] = np.arange(len(order))
    at = np.minimum(np.searchsorted(terms, cut.hash), max(0, len(terms) - 1))
    hit = np.flatnonzero(terms[at] == cut.hash) if len(terms) else np.zeros(0, np.int64)
    owner = np.repeat(place, cut.sizes)[hit]
    code, tf = np.unique(at[hit] * max(1, len(order)) + owner, return_counts=True)
    term, doc = np.divmod(code, max(1, len(order)))
    return Shard(doc_id[order], null[order], cut.sizes[order].astype(np.int64), term.astype(np.int32), doc.astype(np.int32), tf.astype(np.int64))


def impacts(s: Shard, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's share of the score, in whole numbers."""
    m = 25 + (75 * s.n * n_docs) // max(1, n_terms)
    return weights[s.term] * ((1_000_000_000 * s.tf) // (1000 * s.tf + 8 * m[s.doc]))


class Lists:
    """Impact lists of a shard. Terms of weight 0 add nothing to any score and have no list."""

    def __init__(self, s: Shard, impact: np.ndarray, n_query_terms: int) -> None:
        order = np.lexsort((s.doc, -impact, s.term))
        order = order[impact[order] > 0]
        self.n_docs = len(s.n)
        self.docs, self.impact = s.doc[order], impact[order]
        self.bounds = np.searchsorted(s.term[order], np.arange(n_query_terms + 1))

    def top(self, terms: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and scores of the k best documents with a score, best first, and the places read of the longest list."""
        kept = self.bounds[terms + 1] > self.bounds[terms]
        terms, repeats = terms[kept], repeats[kept].astype(np.int64)
        lengths = self.bounds[terms + 1] - self.bounds[terms]
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return best_docs, best, 0
        deepest = int(lengths.max())
        docs = [self.docs[a:b] for a, b in zip(self.bounds[terms], self.bounds[terms + 1], strict=True)]
        share = [self.impact[a:b] * r for a, b, r in zip(self.bounds[terms], self.bounds[terms + 1], repeats, strict=True)]
        place = np.full((len(terms), self.n_docs), -1, np.int32)  # of each document in each list
        for i, d in enumerate(docs):
            place[i, d] = np.arange(len(d), dtype=np.int32)
        seen = [np.zeros(len(d) + 1, bool) for d in docs]  # the last place is never seen: the end of the list
        known = np.zeros(self.n_docs, bool)
        best_at = np.zeros(len(terms), np.int64)  # first unseen place, that is, one past the best position
        read, step = 0, STEP
        while True:
            met = np.concatenate([d[read : read + step] for d in docs])
            read, step = read + step, min(2 * step, MOST)
            new = np.unique(met[~known[met]])
            known[new] = True
            score = np.zeros(len(new), np.int64)
            for i in range(len(terms)):
                at = place[i, new]
                there = at >= 0
                score[there] += share[i][at[there]]
                seen[i][at[there]] = True
                best_at[i] += int(np.argmin(seen[i][best_at[i] :]))
            best_docs, best = np.concatenate([best_docs, new]), np.concatenate([best, score])
            order = np.lexsort((best_docs, -best))[:k]
            best_docs, best = best_docs[order], best[order]
            threshold = sum(int(x[p]) for x, p in zip(share, best_at, strict=True) if p < len(x))
            if threshold == 0 or (len(best) == k and threshold < best[-1]):
                return best_docs, best, min(read, deepest)


def _shards(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A row per shard: the shard, its number of documents and terms, and its documents of each query term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in parts(texts, SHARD_DOCS, SHARD_CHARS):
                s = shard(pdf["doc_id"].iloc[a:b], texts[a:b], terms)
                df = np.bincount(s.term, minlength=len(terms)).astype(np.int64)
                yield pd.DataFrame({"docs": [len(s.n)], "terms": [int(s.n.sum())], "df": [df], "data": [pickle.dumps(s, 5)]})

    return docs.select("doc_id", "text").mapInPandas(run, "docs long, terms long, df array<long>, data binary")


def _rounds(queries: DataFrame, id: str, round_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the queries, in rounds of so many bytes of text."""
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    for k in range(rounds):
        got = queries.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).select(id, "text").collect()
        if got:
            yield [r[0] for r in got], [r[1] for r in got]


def search(docs: DataFrame, queries: DataFrame, id: str = "item_id", k: int = K, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """id (of the query), rank, doc_id, score: the k best documents (doc_id, text) of every query (id, text)."""
    kind = queries.schema[id].dataType
    out = [_search_round(docs, ids, texts, id, kind, k) for ids, texts in _rounds(queries, id, round_bytes)]
    if not out:
        return docs.sparkSession.createDataFrame([], f"`{id}` {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def _search_round(docs: DataFrame, ids: list, texts: list[str | None], id: str, kind: T.DataType, k: int) -> DataFrame:
    cut = words(texts, OUTSIDE, b" ")
    terms = np.unique(cut.hash)
    asked = [np.unique(np.searchsorted(terms, h), return_counts=True) for h in np.split(cut.hash, np.cumsum(cut.sizes)[:-1])]
    shards = materialize(_shards(docs, terms), "shards")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    rows = shards.select(F.posexplode("df").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).collect()  # one per query term
    df = np.zeros(len(terms), np.int64)
    for r in rows:
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                s = pickle.loads(data)
                lists = Lists(s, impacts(s, weights, n_docs, n_terms), len(terms))
                found = [(q, *lists.top(t, n, k)[:2]) for q, (t, n) in enumerate(asked) if len(t)]
                at = np.concatenate([np.zeros(0, np.int64), *[d for _, d, _ in found]])
                frame = pd.DataFrame({"query": np.repeat([q for q, *_ in found], [len(d) for _, d, _ in found]), "doc_id": pd.array(s.doc_id[at], "Int64"), "score": np.concatenate([np.zeros(0, np.int64), *[x for *_, x in found]])})
                frame.loc[s.null[at], "doc_id"] = pd.NA
                yield frame

    best = shards.select("data").mapInPandas(run, "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    spark = docs.sparkSession
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField(id, kind)]))
    return ranked.join(F.broadcast(names), "query").select(id, "rank", "doc_id", "score")


def op13_best_position(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest({_SQL_TERMS}) AS t FROM (SELECT row_number() OVER () AS i, * FROM benchmark WHERE text IS NOT NULL)) GROUP BY 1, 2, 3),
x AS (SELECT i, item_id, r, sum(c * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN d USING (r), s GROUP BY 1, 2, 3),
o AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {K}
"""
