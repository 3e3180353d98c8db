"""Lexical retrieval packing: windows of fixed length filled with documents that resemble each other.

Each task deals its rows to shards of bounded size and keeps a BM25 inverted index over a shard's token ids. A seed
document opens a window; the unused documents that score best against it fill the rest; the last one is cut, and its
remainder opens the next window as the new seed. A shard's last, open window is carried into the next shard, so a
task leaves one window at most that isn't full. Documents are never shuffled: a shard is what a task reads in a row.

Defined results: null text is empty and packs as its closing id alone; ties of the score go to the earlier row;
repeated rows are packed as often as they occur; extra columns are ignored; a text of any length is cut into as many
windows as it needs; an empty table makes no pieces. Sequence ids hold the partition in their upper half.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from caseworks.llm.common import table

WINDOW = 1024
END_ID = 0
#: A shard closes at so many documents or tokens, whichever comes first.
SHARD_DOCS = 1024
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = "byte_bpe_50k"):
    """Function from a text to its ids: those of `tokenizers` with the vocabulary's .json, special tokens included.

    The same vocabulary as ranks encodes ordinary text about three times as fast, with the same ids (tests/llm hold
    the two against each other); a text with the special token's string goes to `tokenizers` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    def encode(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)

    return encode


class Shard:
    """BM25 inverted index over documents given as id arrays. Terms in more than half of them weigh nothing."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        uniques = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [u for u, _ in uniques]
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(n), [len(u) for u in self.terms])
        tf = np.concatenate([c for _, c in uniques]).astype(np.float32)
        size = np.array([len(d) for d in docs], np.float32)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        self.vocab, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.df = df
        self.idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))).astype(np.float32)
        length = K1 * (1 - B + B * size[doc] / max(1.0, float(size.mean())))
        self.doc, self.weight = doc, np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + length)
        self.n = n

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocab, terms)
        at = at[at < len(self.vocab)]
        at = at[np.isin(self.vocab[at], terms) & (self.idf[at] > 0)]
        if not len(at):
            return np.zeros(self.n)
        counts = self.df[at]
        ends = np.cumsum(counts)
        rows = np.arange(ends[-1]) + np.repeat(self.first[at] - ends + counts, counts)
        return np.bincount(self.doc[rows], self.weight[rows], self.n)


class Packer:
    """Pieces of the sequences of one task; the open window lives on from shard to shard."""

    def __init__(self, first_sequence: int, window: int = WINDOW) -> None:
        self.window, self.sequence, self.used = window, first_sequence, 0
        self.pieces: list[tuple] = []

    def put(self, doc_id: int, ids: np.ndarray, start: int) -> int:
        """Place what fits of a document's ids from `start`; returns where it was cut."""
        n = min(len(ids) - start, self.window - self.used)
        part = ids[start : start + n]
        self.pieces.append((doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence, self.used))
        self.used += n
        if self.used == self.window:
            self.sequence, self.used = self.sequence + 1, 0
        return start + n

    def shard(self, doc_ids: list[int], docs: list[np.ndarray]) -> list[tuple]:
        index, unused = Shard(docs), np.ones(len(docs), bool)
        following = 0
        while True:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                break
            seed, at = following, 0
            unused[seed] = False
            while True:  # a chain of seeds: each cut document seeds the window that its remainder opens
                while at < len(docs[seed]):
                    at = self.put(doc_ids[seed], docs[seed], at)
                if not self.used or not unused.any():
                    break
                scores = np.where(unused, index.scores(index.terms[seed]), -1.0)
                opened, cut = self.sequence, None
                while self.sequence == opened and cut is None:
                    best = int(scores.argmax())
                    if scores[best] < 0:
                        break
                    unused[best], scores[best] = False, -1.0
                    at = self.put(doc_ids[best], docs[best], 0)
                    if at < len(docs[best]):
                        cut = best
                if cut is None:
                    break
                seed = cut
        out, self.pieces = self.pieces, []
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", window: int = WINDOW) -> DataFrame:
    """One row per piece of all documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        ids: list[int] = []
        arrays: list[np.ndarray] = []
        held = 0
        frame = lambda rows: pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                arrays.append(np.array([*encode(text or ""), END_ID], np.int32))
                ids.append(doc_id)
                held += len(arrays[-1])
                if len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    yield frame(packer.shard(ids, arrays))
                    ids, arrays, held = [], [], 0
        if ids:
            yield frame(packer.shard(ids, arrays))

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def op4_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
