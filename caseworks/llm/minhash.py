"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts fall together first; their least doc_id stands for all, and counts as often in the statistics.
2. Five-word shingles get document frequencies over the whole table (exchange of parcels by key).
3. A shingle's weight is its count in the document times an inverse frequency damped to [1, 1.5], so that many copies
   of a text don't turn its own shingles worthless. Each sampling function picks a (shingle, level) with probability
   proportional to weight; two documents agree on it with probability of their weighted Jaccard similarity.
4. Bands of four samples: in a band's bucket every document is tied to its leader and the two are verified by exact
   weighted Jaccard. Buckets that still hold unverified pairs of different components go on (leftover.py).
5. Verified pairs (0.8 or more) make the classes, by connected components.

Defined results: null text is the empty text; texts without words are alike only if equal; a text of fewer than five
words is one shingle; repeated rows are members of one class; a class's id is its least doc_id; doc_id identifies a
text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.llm.common import BLOCK_DOCS, append, fits, materialize, n_blocks, numbered, real_id, table, with_block
from caseworks.llm.components import components, grown
from caseworks.llm.exchange import ANSWER, PARCEL, answers, look_up, pack48, parcels, sum_by_key, unpack48
from caseworks.llm.hashing import AT_ONCE, mix, mix_into, shingle_hashes, spaced_hashes, word_hashes
from caseworks.llm.leftover import resolve, ties
from caseworks.plans.shared import shared_dir

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
#: Shingles sampled at once; bounds the arrays of a task.
CHUNK = 1 << 16
_WORDS = re.compile(r"\w+")
#: Each byte of ASCII text, and a space for those of no word.
_ASCII_WORDS = bytes(i if _WORDS.match(chr(i)) else 32 for i in range(256))

_rng = np.random.default_rng(20)
#: Random variates of the sampling, drawn from tables by bits of a shingle's hash: Gamma(2, 1), its logarithm, uniform.
GAMMA = -np.log1p(-_rng.random((2, 1 << 16))).sum(0).astype(np.float32)
LOG_GAMMA = np.log(-np.log1p(-_rng.random((2, 1 << 16))).sum(0)).astype(np.float32)
UNIFORM = _rng.random(1 << 16).astype(np.float32)


def text_hashes(text: str) -> np.ndarray:
    """Hashes of the runs of word characters; of ASCII text straight from its bytes."""
    if text.isascii() and len(text) < AT_ONCE:
        return spaced_hashes(text.encode().translate(_ASCII_WORDS) + b" ")
    return word_hashes(_WORDS.findall(text))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, in order, and their counts."""
    return np.unique(shingle_hashes(text_hashes((text or "").lower()), SHINGLE), return_counts=True)


def weights(counts: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    rarity = np.log((n_docs + 1) / np.minimum(df, n_docs)) / np.log(n_docs + 1)
    return counts * (1 + 0.5 * rarity)


def signatures(keys: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples (documents x BANDS * ROWS) of concatenated documents, each of at least one shingle."""
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(sizes), BANDS * ROWS), np.uint64)
    bits, at = np.empty(len(keys), np.uint64), np.empty(len(keys), np.intp)
    r, log_c, beta, level, log_a = (np.empty(len(keys), np.float32) for _ in range(5))  # filled anew by each function
    for f in range(BANDS * ROWS):
        mix_into(keys ^ mix(np.array([f + 1], np.uint64)), bits)
        for shift, variates, drawn in ((0, GAMMA, r), (16, LOG_GAMMA, log_c), (32, UNIFORM, beta)):
            np.copyto(at, (bits >> np.uint64(shift)).astype(np.uint16))
            variates.take(at, out=drawn, mode="clip")  # no place is outside; clip needs no copy of out
        np.floor(np.add(np.divide(log_w, r, out=level), beta, out=level), out=level)
        np.multiply(np.subtract(level, beta, out=log_a), r, out=log_a)
        np.subtract(np.subtract(log_c, log_a, out=log_a), r, out=log_a)
        hit = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, start), sizes))
        if len(hit) > len(sizes):  # of equal ones the first counts
            doc = np.searchsorted(start, hit, "right")
            hit = hit[np.concatenate([[True], doc[1:] != doc[:-1]])]
        out[:, f] = mix(keys[hit] ^ mix(level[hit].astype(np.int64).view(np.uint64) + np.uint64(f)))
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        for i in range(ROWS):
            out[:, b] = mix(out[:, b] ^ samples[:, b * ROWS + i]) + np.uint64(b + 1)
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def _texts(docs: pd.DataFrame, ids: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(doc_id, shingles, counts) of the block's documents among ids, each id once; wordless ones are left out."""
    for doc_id, text in zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True):
        if doc_id in ids:
            ids.discard(doc_id)
            keys, counts = shingles(text)
            if len(keys):
                yield doc_id, keys, counts


def _kind(side: pd.DataFrame, kind: str) -> pd.DataFrame:
    return side[side["kind"] == kind]


def _send_frequencies(buckets: int):
    def send(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        copies = dict(zip(side["a"].tolist(), side["b"].tolist(), strict=True))
        found = list(_texts(docs, set(copies)))
        if not found:
            return parcels(0, buckets, np.zeros(0, np.uint64), lambda p: None)
        keys = np.concatenate([k for _, k, _ in found])
        times = np.concatenate([np.full(len(k), copies[i], np.int64) for i, k, _ in found])
        keys, times = sum_by_key(keys >> np.uint64(16) << np.uint64(16), times)
        return parcels(int(side["block"].iloc[0]), buckets, keys >> np.uint64(16), lambda p: (pack48(keys[p[times[p] == 1]]), pack48(keys[p[times[p] > 1]]), times[p[times[p] > 1]]))

    return send


def _answer_frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket, its keys held by two documents or more."""
    got = [(unpack48(once), unpack48(many), times) for once, many, times in map(pickle.loads, pdf["data"])]
    keys, df = sum_by_key(np.concatenate([x for once, many, _ in got for x in (once, many)]), np.concatenate([x for once, _, times in got for x in (np.ones(len(once), np.int64), times)]))
    keys, df = keys[df > 1], df[df > 1]
    out = []
    for block, (once, many, _) in zip(pdf["block"].tolist(), got, strict=True):
        own = np.concatenate([once, many])
        n = look_up(own, keys, df, 1)
        if (n > 1).any():
            out.append((block, "df", 0, 0, pickle.dumps((pack48(own[n > 1]), n[n > 1].astype(np.int64)), 5)))
    return answers(out)


def _frequencies(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = [pickle.loads(x) for x in _kind(side, "df")["data"]]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, df = np.concatenate([unpack48(k) for k, _ in got]), np.concatenate([n for _, n in got])
    order = np.argsort(keys)
    return keys[order], df[order]


def _vectors(docs: pd.DataFrame, side: pd.DataFrame, ids: set[int], n_docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    known, df = _frequencies(side)
    for doc_id, keys, counts in _texts(docs, ids):
        yield doc_id, keys, weights(counts, look_up(keys >> np.uint64(16) << np.uint64(16), known, df, 1), n_docs)


def _sign(n_docs: int):
    def sign(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        out, held, size = [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                found = bands(signatures(np.concatenate([k for _, k, _ in held]), np.concatenate([w for _, _, w in held]), np.array([len(k) for _, k, _ in held])))
                ids = np.repeat(np.array([i for i, _, _ in held], np.int64), BANDS)
                out.append(pd.DataFrame({"band": found.reshape(-1).view(np.int64), "doc": ids}))
            held, size = [], 0

        for row in _vectors(docs, side, set(_kind(side, "rep")["a"].tolist()), n_docs):
            held.append(row)
            size += len(row[1])
            if size >= CHUNK:
                flush()
        flush()
        return pd.concat(out) if out else pd.DataFrame({"band": pd.Series([], dtype="int64"), "doc": pd.Series([], dtype="int64")})

    return sign


def _spell(n_docs: int):
    def spell(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": i, "token": keys.view(np.int64), "weight": w.astype(np.float64)}) for i, keys, w in _vectors(docs, side, set(_kind(side, "rep")["a"].tolist()), n_docs)]
        return pd.concat(found) if found else pd.DataFrame({"id": [], "token": [], "weight": []})

    return spell


def _send_leaders(n_docs: int):
    def send(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        asked = _kind(side, "ask").groupby("a")["b"].unique().to_dict()
        out = []
        for doc_id, keys, w in _vectors(docs, side, set(asked), n_docs):
            data = pickle.dumps((keys, w.astype(np.float32)), 5)
            out += [(int(block), "leader", doc_id, 0, data) for block in asked[doc_id]]
        return answers(out)

    return send


def _verify(n_docs: int):
    def verify(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        leaders = {a: pickle.loads(x) for a, x in zip(_kind(side, "leader")["a"].tolist(), _kind(side, "leader")["data"], strict=True)}
        pairs = _kind(side, "pair").groupby("a")["b"].unique().to_dict()
        out = []
        for doc_id, keys, w in _vectors(docs, side, set(pairs), n_docs):
            own = (keys, w.astype(np.float32))
            out += [(doc_id, int(other), weighted_jaccard(own, leaders[other])) for other in pairs[doc_id]]
        return pd.DataFrame(out, columns=["member", "leader", "similarity"]).astype({"member": "int64", "leader": "int64", "similarity": "float64"})

    return verify


#: Numbers of documents without a doc_id of their own lie under this one, where no doc_id is expected.
_ODD = -(1 << 61)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, class_id, n_links (verified pairs of the document's text) for each row of docs (doc_id, text)."""
    blocks, n_docs = n_blocks(docs, block_docs), docs.count()
    buckets = max(16, blocks // 4)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.select("doc_id", F.md5("text").alias("h"))
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    member_of = materialize(hashed.join(groups, "h").select("doc_id", "rep", "n"), "copies")
    reps = with_block(member_of.where("doc_id = rep").select("rep", "n").distinct(), "rep", blocks)
    side = lambda df, kind, a, b: df.select("block", F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).cast("long").alias("b"), F.lit(None).cast("binary").alias("data"))
    rep_rows = side(reps, "rep", "rep", "n")
    by_block = with_block(texts, "doc_id", blocks).groupBy("block")
    df = by_block.cogroup(rep_rows.groupBy("block")).applyInPandas(_send_frequencies(buckets), PARCEL).groupBy("bucket").applyInPandas(_answer_frequencies, ANSWER)
    df = materialize(df, "frequencies")
    signed = by_block.cogroup(rep_rows.unionByName(df).groupBy("block")).applyInPandas(_sign(n_docs), "band long, doc long")
    tied = materialize(ties(signed.select("band", F.col("doc").alias("id")), ends=False), "ties")
    # all rounds add their links to one Parquet folder, so plans stay as small as in the first round
    at = f"{shared_dir(docs.sparkSession)}/links-{uuid.uuid4().hex}"
    links = None
    named = lambda df: with_block(texts.join(df, "doc_id", "left_semi"), "doc_id", blocks).groupBy("block")

    def check(pairs: DataFrame) -> None:
        nonlocal links
        if links is not None:
            pairs = pairs.join(links.select("member", "leader"), ["member", "leader"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return
        near = named(pairs.select(F.col("member").alias("doc_id")).unionByName(pairs.select(F.col("leader").alias("doc_id"))).distinct())
        ask = with_block(pairs, "member", blocks).select(F.col("block").alias("at"), "leader").distinct()
        ask = side(with_block(ask, "leader", blocks), "ask", "leader", "at")
        sent = near.cogroup(ask.unionByName(df).groupBy("block")).applyInPandas(_send_leaders(n_docs), ANSWER)
        asked = side(with_block(pairs, "member", blocks), "pair", "member", "leader")
        checked = near.cogroup(sent.unionByName(asked).unionByName(df).groupBy("block")).applyInPandas(_verify(n_docs), "member long, leader long, similarity double")
        append(checked, at)
        links = docs.sparkSession.read.schema("member long, leader long, similarity double").parquet(at)

    parts_of = None

    def parts() -> DataFrame:
        nonlocal parts_of
        good = links.where(F.col("similarity") >= threshold)
        parts_of = materialize(components(good, "member", "leader"), "parts") if parts_of is None else grown(parts_of, good, "member", "leader")
        return parts_of

    def made_of(ids: DataFrame) -> DataFrame:
        asked = side(with_block(ids, "id", blocks), "rep", "id", "id")
        return named(ids.select(F.col("id").alias("doc_id"))).cogroup(asked.unionByName(df).groupBy("block")).applyInPandas(_spell(n_docs), "id long, token long, weight double")

    check(tied.select(F.col("id").alias("member"), "leader").distinct())
    if links is not None:
        resolve(tied, check, parts, made_of, threshold)
    if links is None:
        return member_of.select("doc_id", F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    links = links.where(F.col("similarity") >= threshold)
    found = parts().select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    ends = links.select(F.col("member").alias("rep")).unionByName(links.select(F.col("leader").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = member_of.join(found.join(ends, "rep"), "rep", "left")
    return out.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op7_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    """Rows without a doc_id are documents, too: their doc_id stays null, and a class of none but such has a number of its
    own under all others."""
    found = near_duplicates(numbered(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.withColumn("doc_id", real_id())


def _distinct_ids(docs: DataFrame) -> DataFrame:
    """docs with _id: the doc_id, or a number from id and text where the id is null or stands for several texts."""
    several = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("doc_id IS NOT NULL AND a <> b")
    several = fits(materialize(several.select(F.col("doc_id").alias("_several")), "repeated-ids"))  # as a rule none
    own = F.lit(_ODD) - F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(9)), 3)
    return docs.join(several, F.col("doc_id") == F.col("_several"), "left").withColumn("_id", F.when(F.col("doc_id").isNull() | F.col("_several").isNotNull(), own).otherwise(F.col("doc_id"))).drop(several["_several"])


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the least doc_id, but before all others one whose doc_id is null or stands for
    several texts. Of equal rows, and of rows with one doc_id and one text, one stays; rows with one doc_id and different
    texts are documents of their own, and so are null and empty texts (all alike: one stays). Extra columns of any name
    but _id and _several stay as they are; an empty table stays empty."""
    rows = _distinct_ids(docs)
    found = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"))
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(kept, "_id", "left_semi").dropDuplicates(["_id"]).select(docs.columns)
