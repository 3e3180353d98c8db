"""An inverted index in blocks: a term's ids, in order, are rows of up to so many ids each, coded as differences, with the
first and the last one, so that a lookup of several terms decodes only blocks that may meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.operators.intervals import interval_join
from caseworks.operators.search import term_postings

BLOCK_IDS = 512
#: Ids in a stretch: what a task holds of a frequent term at least, if documents are numbered without gaps.
DEALT_IDS = 1 << 16
INDEX = "term string, first long, last long, n int, width int, gaps binary"


def _coded(ids: np.ndarray) -> tuple[int, int, int, int, bytes]:
    """first, last, number, bytes a gap, gaps of ids in order."""
    gaps = np.diff(ids)
    top = int(gaps.max()) if len(gaps) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return int(ids[0]), int(ids[-1]), len(ids), width, gaps.astype(f"<u{width}").tobytes()


def _decoded(first: int, width: int, gaps: bytes) -> np.ndarray:
    return first + np.concatenate([[0], np.cumsum(np.frombuffer(gaps, f"<u{width}").astype(np.int64))])


def index_blocks(docs: DataFrame, id: str, text: str, block: int = BLOCK_IDS) -> DataFrame:
    """term, first, last, n, width, gaps of each block of whole-number ids, at most `block` a row. Terms are those of
    term_postings; null ids and texts have none, repeated ids count once.

    Postings are dealt by term and stretch of DEALT_IDS ids and sorted, once and without looking at them before, so a term of all
    documents spans many tasks, none of which holds more than a block; a block ends where its task's ids of the term do. Repeated
    ids meet in one task.
    """
    rows = term_postings(docs.where(F.col(id).isNotNull()), id, text).select("term", F.col(id).cast("long").alias("id"))
    dealt = rows.repartition("term", F.floor(F.col("id") / DEALT_IDS)).sortWithinPartitions("term", "id")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_term, held, last = None, np.zeros(0, np.int64), None
        for pdf in batches:
            terms, ids, out = pdf["term"].to_numpy(object), pdf["id"].to_numpy(np.int64), []
            cuts = np.concatenate([[0], np.flatnonzero(terms[1:] != terms[:-1]) + 1, [len(terms)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if terms[a] != held_term:
                    out += [(held_term, *_coded(held))] if len(held) else []
                    held_term, held, last = terms[a], ids[:0], None
                own = ids[a:b]
                own = own[np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])]
                held, last = np.concatenate([held, own]), ids[b - 1]
                while len(held) >= block:
                    out.append((held_term, *_coded(held[:block])))
                    held = held[block:]
            if out:
                yield _frame(out)
        if len(held):
            yield _frame([(held_term, *_coded(held))])

    return dealt.mapInPandas(code, INDEX)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"term": object, "gaps": object, "n": "int32", "width": "int32"})


def unpack(index: DataFrame) -> DataFrame:
    """(term, id) of all blocks."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [_decoded(f, w, g) for f, w, g in zip(pdf["first"], pdf["width"], pdf["gaps"], strict=True)]
            yield pd.DataFrame({"term": pd.Series(np.repeat(pdf["term"].to_numpy(object), pdf["n"]), dtype=object), "id": np.concatenate([np.zeros(0, np.int64), *ids])})

    return index.select("term", "first", "width", "n", "gaps").mapInPandas(decode, "term string, id long")


def document_counts(index: DataFrame) -> DataFrame:
    """term and in how many documents it stands, without decoding."""
    return index.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))


def meeting_blocks(index: DataFrame, terms: list[str]) -> DataFrame:
    """The blocks of the terms that overlap a block of the rarest of them; all of the rarest term's own."""
    wanted = index.where(F.col("term").isin(terms))
    by_size = document_counts(wanted).orderBy("n", "term").collect()  # a row for each term of the query
    if len(by_size) < len(set(terms)):
        return wanted.limit(0)
    rare = wanted.where(F.col("term") == by_size[0].term)
    others = wanted.where(F.col("term") != by_size[0].term)
    one, end = F.lit(0).alias("_k"), (F.col("last") + 1).alias("_end")
    begun_inside = interval_join(rare.select(one, F.col("first").alias("_p")), others.select(one, *index.columns, end), "_k", "_p", "first", "_end")
    around = rare.select(one, F.col("first").alias("_from_id"), end)
    begins_inside = interval_join(others.select(one, *index.columns), around, "_k", "first", "_from_id", "_end")
    met = begun_inside.select(index.columns).unionByName(begins_inside.select(index.columns))
    return rare.unionByName(met.dropDuplicates(["term", "first"]))


def lookup_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """id of the documents that hold every one of the terms."""
    terms = sorted(set(terms))
    ids = unpack(meeting_blocks(index, terms))
    return ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("id")
