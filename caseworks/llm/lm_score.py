"""Document log-likelihoods: add-one unigrams over the whole corpus, and a gated recurrent model on top of them.

1. Blocks of documents (by a hash of doc_id, each in the order of doc_id and text) become token numbers once, and are
   written; they send the counts of their distinct tokens to key buckets. Buckets sum them over the training documents
   and answer with the corpus counts (exchange of parcels). Every distinct token of the corpus takes part.
2. The most frequent tokens are the vocabulary of a GRU (gru.py). It is trained on every block's training documents from
   the same start, with a gradient in every window; the blocks' weights are averaged by tokens, as whole numbers, in one
   aggregation. So the model follows from the rows alone, not from how Spark has split them.
3. Scoring runs each whole document through the GRU, its state carried across windows. A token outside the vocabulary
   costs the model's unknown word times an add-one unigram over the rest of the corpus's tokens.

Defined results: null text is empty and scores its end alone; without training documents all counts are 0; repeated
rows count as often as they occur; texts of any length are scored whole; extra columns are ignored; an empty table
gives no rows. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.llm import gru
from caseworks.llm.common import crc_mod, materialize, n_blocks, table, with_block
from caseworks.llm.exchange import ANSWER, PARCEL, answers, look_up, parcels, sum_by_key
from caseworks.llm.hashing import token_hashes

#: Words of the recurrent model, besides the unknown word and the end.
VOCABULARY = 1022
BLOCK_DOCS = 4000
#: Documents that the model trains on at once.
TRAIN_DOCS = 8192
#: Weights are summed as whole numbers of this fraction, times hundreds of tokens.
UNIT = 1 << 14
#: Stands for the end of a document among token hashes.
END = np.uint64(0x5D0E0D5D0E0D5D0E)
UNKNOWN_ID, END_ID = 0, 1


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, A-Z in lower case, each text's followed by the end, and how many each has."""
    held, sizes = token_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    return np.insert(held, np.cumsum(sizes), END), sizes + 1


def _prepare(buckets: int):
    """The block's documents in token numbers, as one row, and its counts for the buckets."""

    def prepare(docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "text"], kind="stable")
        held, sizes = tokens(docs["text"].tolist())
        codes, keys = pd.factorize(held)
        out = docs["held_out"].to_numpy(bool)
        counts = np.bincount(codes[np.repeat(~out, sizes)], minlength=len(keys))
        block = int(docs["block"].iloc[0])
        ids = (docs["doc_id"].fillna(0).to_numpy(np.int64), docs["doc_id"].isna().to_numpy())
        small = np.uint16 if len(keys) < 1 << 16 else np.uint32
        own = pd.DataFrame({"bucket": [-1], "block": [block], "data": [pickle.dumps((*ids, out, sizes, keys, counts, codes.astype(small)), 5)]})
        sent = parcels(block, buckets, keys, lambda p: (keys[p], counts[p].astype(np.int32)))
        return pd.concat([own.astype(sent.dtypes.to_dict()), sent]).assign(sent=lambda x: x["bucket"] >= 0)

    return prepare


def _answer_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block the counts that differ from its own; to all, the bucket's totals and most frequent tokens."""
    got = [pickle.loads(x) for x in pdf["data"]]
    keys, counts = sum_by_key(np.concatenate([k for k, _ in got]), np.concatenate([n for _, n in got]).astype(np.int64))
    out = []
    for block, (k, n) in zip(pdf["block"].tolist(), got, strict=True):
        total = look_up(k, keys, counts, 0)
        new = total != n
        if new.any():
            out.append((block, "counts", 0, 0, pickle.dumps((k[new], total[new]), 5)))
    out.append((-1, "totals", int(counts.sum()), int((counts > 0).sum()), None))
    top = np.lexsort((keys, -counts))[: VOCABULARY + 1]
    out += [(-1, "top", int(k), int(n), None) for k, n in zip(keys[top].view(np.int64), counts[top], strict=True) if n > 0]
    return answers(out)


class Vocabulary:
    def __init__(self, words: list[tuple[int, int]], n_tokens: int, n_distinct: int, ends: int) -> None:
        keys = np.array([k for k, _ in words], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], (np.arange(len(keys)) + 2)[order]
        self.counts = np.array([0, ends, *[n for _, n in words]], np.float64)
        self.n_tokens, self.n_distinct = n_tokens, n_distinct
        self.counts[UNKNOWN_ID] = n_tokens - self.counts.sum()
        #: Tokens of the training documents outside the vocabulary, and how many of them are distinct.
        self.rest = int(self.counts[UNKNOWN_ID])
        self.rest_distinct = n_distinct - len(keys) - (ends > 0)

    def encode(self, held: np.ndarray) -> np.ndarray:
        ids = look_up(held, self.keys, self.ids, UNKNOWN_ID)
        ids[held == END] = END_ID
        return ids


def _documents(codes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(codes, np.cumsum(sizes)[:-1])


def _train(blocks: DataFrame, vocabulary: Vocabulary) -> gru.Params:
    """Training on every block from one start, then the average of the weights by tokens."""
    start = gru.initial(vocabulary.counts)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                _, _, out, sizes, keys, _, codes = pickle.loads(data)
                docs = [d for d, o in zip(_documents(vocabulary.encode(keys).astype(np.int16)[codes], sizes), out, strict=True) if not o]
                trainer = gru.Trainer(start)
                for a in range(0, len(docs), TRAIN_DOCS):
                    trainer.learn(docs[a : a + TRAIN_DOCS])
                if trainer.tokens:
                    weight = -(-trainer.tokens // 100)
                    values = np.rint(gru.flat(trainer.p).astype(np.float64) * UNIT).astype(np.int64) * weight
                    yield pd.DataFrame({"at": np.arange(len(values), dtype=np.int32), "value": values, "weight": weight})

    parts = blocks.select("data").mapInPandas(learn, "at int, value long, weight long")
    sums = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("weight").alias("weight"))
    rows = sums.select("at", (F.col("value").cast("double") / F.col("weight")).alias("value")).toPandas().sort_values("at")  # one row per weight
    return gru.unflat(rows["value"].to_numpy() / UNIT, len(vocabulary.counts)) if len(rows) else start


def _score(vocabulary: Vocabulary, params: gru.Params):
    def score(block: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for data in block["data"]:
            ids, null, out, sizes, keys, counts, codes = pickle.loads(data)
            order = np.argsort(keys)
            counts = counts.copy()
            for x in side["data"]:
                k, n = pickle.loads(x)
                counts[order[np.searchsorted(keys, k, sorter=order)]] = n
            v = vocabulary
            encoded = v.encode(keys)
            base = np.log10((counts + 1) / (v.n_tokens + v.n_distinct + 1))
            unknown = np.where(encoded == UNKNOWN_ID, np.log((counts + 1) / (v.rest + v.rest_distinct + 1)), 0.0)
            first = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x[codes], first)  # noqa: B023, E731
            own = gru.log_likelihood(params, _documents(encoded.astype(np.int16)[codes], sizes))
            frame = {"doc_id": pd.array(ids, "Int64"), "held_out": out, "n_tokens": sizes, "n_known": total((counts > 0).astype(np.int64)), "train_tokens": v.n_tokens}
            frame = pd.DataFrame(frame | {"base_score": total(base), "score": (own + total(unknown)) / np.log(10)})
            frame.loc[null, "doc_id"] = pd.NA
            frames.append(frame)
        return pd.concat(frames) if frames else pd.DataFrame({x.split()[0]: [] for x in SCORES.split(", ")})

    return score


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Scores of docs (doc_id, text, held_out); learns from the rows that aren't held out."""
    blocks = n_blocks(docs, block_docs)
    buckets = max(16, blocks)
    dealt = with_block(docs.select("doc_id", "text", "held_out"), "doc_id", blocks)
    prepared = materialize(dealt.groupBy("block").applyInPandas(_prepare(buckets), PARCEL + ", sent boolean"), "tokens", "sent")
    held = prepared.where("NOT sent").select("block", "data")
    counted = materialize(prepared.where("sent").drop("sent").groupBy("bucket").applyInPandas(_answer_counts, ANSWER), "token-counts")
    totals = counted.where("kind = 'totals'").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    end = int(np.array([END]).view(np.int64)[0])
    top = counted.where("kind = 'top'")
    words = top.where(F.col("a") != end).orderBy(F.desc("b"), "a").limit(VOCABULARY).collect()
    ends = top.where(F.col("a") == end).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    vocabulary = Vocabulary([(r.a, r.b) for r in words], totals[0], totals[1], ends)
    params = _train(held, vocabulary)
    return held.groupBy("block").cogroup(counted.where("kind = 'counts'").groupBy("block")).applyInPandas(_score(vocabulary, params), SCORES)


def op9_gru_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))
    return score_documents(docs)
