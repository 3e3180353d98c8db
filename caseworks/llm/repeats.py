"""Exact substring dedup: bytes covered by a 50-byte string that also starts in an earlier document.

0. Equal texts fall together first; the smallest doc_id's stands for them.
1. Every 50-byte window has a key: the least hash among its k-grams. Equal windows have equal keys, and consecutive
   windows with one key form a segment, so a text is about as many segments as a fourteenth of its bytes.
2. Blocks of documents send the distinct keys to key buckets; keys of one document only can't repeat and end there.
3. For the other keys, blocks send their distinct segments with the least doc_id of each. A bucket sorts all suffixes
   of the segments of a key, as far as they may share windows, by linear grouping (suffix_order); neighbours in that order
   that share 50 bytes form the classes of equal windows, each with its least document.
4. The answers return to the blocks, which mark windows, remove the covered bytes and digest the rest.

A block sends a key or segment once, however many of its documents hold it, so copies don't pile up in a bucket.

Defined results: null text is empty; texts under 50 bytes lose nothing; of rows with the same doc_id none is earlier
than the other; equal texts lose all bytes but for the smallest doc_id's; any length is processed whole; extra
columns are ignored; an empty table gives no rows. A false equality would need equal 64-bit hashes of different keys.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.llm.common import BLOCK_DOCS, materialize, n_blocks, numbered, real_id, table, with_block
from caseworks.llm.exchange import ANSWER, PARCEL, among, answers, pack48, parcels, unpack48
from caseworks.llm.suffix_order import suffix_order

LENGTH = 50
GRAM = 30
#: Steps in which places of the least k-gram in a window are told apart; divides LENGTH - GRAM.
STEP = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A symbol between segments, below every byte.
_BREAK = -1
#: A byte that UTF-8 doesn't have.
_SAME = b"\xff"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of each k-gram; none for texts without a window."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        one = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        gram, size, power = one, 1, _MULTIPLIER
        for bit in bin(GRAM)[3:]:  # k-gram hashes by doubling
            gram, size, power = gram[: len(gram) - size] * power + gram[size:], size * 2, power * power
            if bit == "1":
                gram, size, power = gram[:-1] * _MULTIPLIER + one[size : size + len(gram) - 1], size + 1, power * _MULTIPLIER
        return _mix(gram)


def window_keys(low: np.ndarray) -> np.ndarray:
    """Key of each 50-byte window, from the hashes of its k-grams."""
    if not len(low):
        return low
    with np.errstate(over="ignore"):
        width, size = LENGTH - GRAM + 1, 1
        while size * 2 <= width:
            low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        return _mix(low * _MULTIPLIER)  # least values lean low; mixed again they fill the buckets evenly


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and ends of the runs of consecutive windows with one key."""
    keys = window_keys(gram_hashes(data))
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], start, np.append(start[1:], len(keys))


def anchors(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the least k-gram of each segment (first window, end) lies in it; -1 if it occurs more than once there."""
    low, width = gram_hashes(data), np.arange(LENGTH - GRAM + 1)
    first = start + low[start[:, None] + width].argmin(1)
    last = end - 1 + len(width) - 1 - low[(end - 1)[:, None] + width][:, ::-1].argmin(1)
    return np.where(first == last, first - start, -1).astype(np.int32)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _firsts(docs: pd.DataFrame, side: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    """(doc_id, bytes) of the block's documents that are the first of their text, each once."""
    left = set(side.loc[side["kind"] == "first", "a"].tolist())
    for doc_id, text in zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True):
        if doc_id in left:
            left.discard(doc_id)
            yield doc_id, _raw(text)


def _send_keys(buckets: int):
    def send(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        held = [np.unique(segments(data)[0]) >> np.uint64(16) for _, data in _firsts(docs, side)]
        if not held:
            return parcels(0, buckets, np.zeros(0, np.uint64), lambda p: None)
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        several = n > 1
        return parcels(int(side["block"].iloc[0]), buckets, keys, lambda p: (pack48(keys[p[several[p]]] << np.uint64(16)), pack48(keys[p[~several[p]]] << np.uint64(16))))

    return send


def _repeated_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket, its keys (their upper 48 bits) that more than one document holds."""
    got = [tuple(map(unpack48, pickle.loads(x))) for x in pdf["data"]]
    keys, n = np.unique(np.concatenate([np.concatenate([many, many, once]) for many, once in got]), return_counts=True)
    keys = keys[n > 1]
    out = []
    for block, (many, once) in zip(pdf["block"].tolist(), got, strict=True):
        again = once[among(once, keys)]
        if len(many) + len(again):
            out.append((block, "keys", 0, 0, pack48(np.concatenate([many, again]))))
    return answers(out)


def _send_segments(buckets: int):
    def send(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        packed = side.loc[side["kind"] == "keys", "data"]
        keys = np.sort(unpack48(b"".join(packed))) if len(packed) else np.zeros(0, np.uint64)
        least: dict[tuple[int, bytes], tuple[int, int]] = {}
        for doc_id, data in _firsts(docs, side):
            k, start, end = segments(data)
            hit = np.flatnonzero(among(k >> np.uint64(16) << np.uint64(16), keys))
            if not len(hit):
                continue
            at = anchors(data, start[hit], end[hit])
            for key, a, b, anchor in zip(k[hit].tolist(), start[hit].tolist(), (end[hit] + LENGTH - 1).tolist(), at.tolist(), strict=True):
                own = (key, data[a:b])
                if own not in least or least[own][0] > doc_id:
                    least[own] = (doc_id, anchor)
        texts = [t for _, t in least]
        keys, size = np.array([k for k, _ in least], np.uint64), np.array([len(t) for t in texts], np.int32)
        firsts, at = np.array([d for d, _ in least.values()], np.int64), np.array([x for _, x in least.values()], np.int32)
        block = int(side["block"].iloc[0]) if len(side) else 0
        return parcels(block, buckets, keys, lambda p: (keys[p], firsts[p], at[p], size[p], b"".join([texts[i] for i in p.tolist()])))

    return send


def may_share(texts: dict[bytes, int], at: dict[bytes, int]) -> tuple[dict[bytes, tuple[int, bytes]], int]:
    """The segments that may share a window with another, each with the part (first byte, bytes) of it that these windows lie
    in, and the bytes of a window there. The least k-gram is the same for all; in a part it is one byte, which no text has.

    Equal windows lie alike around the least k-gram. With o bytes of a window left of it, and o from x to x + STEP, they agree on
    x bytes left of it and on LENGTH - GRAM - STEP - x right of it. Where a segment holds it twice, all of all may be shared.
    """
    if min(at[t] for t in texts) < 0:
        return {t: (0, t) for t in texts}, LENGTH
    size = LENGTH - STEP
    cores = {t: [(x, t[at[t] - x : at[t] - x + size]) for x in range(0, LENGTH - GRAM, STEP) if 0 <= at[t] - x <= len(t) - size] for t in texts}
    n = Counter(core for own in cores.values() for core in own)
    out = {}
    for t, own in cores.items():
        shared = [x for x, core in own if n[x, core] > 1]
        if shared:
            a, b = max(0, at[t] - shared[-1] - STEP), at[t] - shared[0] + LENGTH
            out[t] = (a, t[a : at[t]] + _SAME + t[at[t] + GRAM : b])
    width = LENGTH - GRAM + 1
    return {t: part for t, part in out.items() if len(part[1]) >= width}, width


def earlier_windows(texts: dict[bytes, int], parts: dict[bytes, tuple[int, bytes]], width: int = LENGTH) -> dict[bytes, list[tuple[int, int]]]:
    """Of distinct segments with their least documents: the runs of windows (width bytes in a part) that a smaller document
    than that holds in its part.

    The suffixes of all distinct parts are sorted together; equal windows are neighbours there.
    """
    least: dict[bytes, int] = {}  # document of a part
    for text, (_, part) in parts.items():
        least[part] = min(texts[text], least.get(part, texts[text]))
    held = {part: [doc] * (len(part) - width + 1) for part, doc in least.items()}  # least document of each window
    if len(least) > 1:
        _spread(held, width)
    runs = {}
    for text, (a, part) in parts.items():
        early = [i for i, doc in enumerate(held[part], a) if doc < texts[text]]
        if early:
            cut = [i for i in range(1, len(early)) if early[i] > early[i - 1] + 1]
            runs[text] = [(early[i], early[j - 1] + 1) for i, j in zip([0, *cut], [*cut, len(early)], strict=True)]
    return runs


def _spread(held: dict[bytes, list[int]], width: int) -> None:
    """Give each window of distinct texts, in place, the least of the numbers that equal windows of all texts have."""
    symbols: list[int] = []
    owner: list[int] = []
    starts: list[int] = []
    opens = bytearray()  # whether a window starts at a symbol
    names = list(held)
    for k, text in enumerate(names):
        starts.append(len(symbols))
        symbols += text
        symbols.append(_BREAK)
        owner += [k] * (len(text) + 1)
        opens += bytes([1]) * (len(text) - width + 1) + bytes(width)

    def close(same: list[tuple[list[int], int]]) -> None:
        least = min(docs[i] for docs, i in same)
        for docs, i in same:
            docs[i] = least

    same: list[tuple[list[int], int]] = []
    window = None
    for at in suffix_order(symbols):
        if not opens[at]:
            continue
        text, i = names[owner[at]], at - starts[owner[at]]
        own = text[i : i + width]
        if own != window:
            if len(same) > 1:
                close(same)
            same, window = [], own
        same.append((held[text], i))
    if len(same) > 1:
        close(same)


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket: keys, segment hashes, least documents and, for these, the windows held earlier."""
    got = []
    by_key: dict[int, dict[bytes, int]] = defaultdict(dict)
    place: dict[int, dict[bytes, int]] = defaultdict(dict)
    for block, x in zip(pdf["block"].tolist(), pdf["data"], strict=True):
        keys, firsts, at, size, joined = pickle.loads(x)
        ends = np.cumsum(size).tolist()
        texts = [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        got.append((block, keys.tolist(), texts))
        for key, text, doc, anchor in zip(got[-1][1], texts, firsts.tolist(), at.tolist(), strict=True):
            of = by_key[key]
            of[text] = min(doc, of.get(text, doc))
            place[key][text] = anchor
    near = {k: may_share(t, place[k]) for k, t in by_key.items() if len(t) > 1}
    runs = {k: earlier_windows(by_key[k], *parts) for k, parts in near.items()}
    out = []
    for block, keys, texts in got:
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
        least = np.array([by_key[k][t] for k, t in zip(keys, texts, strict=True)], np.int64)
        early = {i: runs[k][t] for i, (k, t) in enumerate(zip(keys, texts, strict=True)) if k in runs and t in runs[k]}
        out.append((block, "judged", 0, 0, pickle.dumps((np.array(keys, np.uint64), hashes, least, early), 5)))
    return answers(out)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(keep_text: bool):
    def remove(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        known: dict[tuple[int, int], tuple[int, tuple]] = {}
        for x in side.loc[side["kind"] == "judged", "data"]:
            keys, hashes, least, early = pickle.loads(x)
            for i, (k, h, doc) in enumerate(zip(keys.tolist(), hashes.tolist(), least.tolist(), strict=True)):
                known[k, h] = (doc, early.get(i, ()))
        keys = np.unique(np.array([k for k, _ in known], np.uint64))
        out = []
        for doc_id, data in _firsts(docs, side):
            edge = np.zeros(len(data) + 1, np.int64)
            if len(keys):
                k, start, end = segments(data)
                hit = np.flatnonzero(among(k, keys))
                for key, a, b in zip(k[hit].tolist(), start[hit].tolist(), end[hit].tolist(), strict=True):
                    least, runs = known.get((key, xxhash.xxh3_64_intdigest(data[a : b + LENGTH - 1])), (doc_id, ()))
                    for x, y in ((0, b - a),) if least < doc_id else runs:
                        edge[a + x] += 1
                        edge[a + y + LENGTH - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(gone) else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
            row = (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if keep_text else row)
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")] + ["kept"] * keep_text).astype({"doc_id": "int64", "n_bytes": "int64", "n_removed": "int64", "n_spans": "int64"})

    return remove


def remove_repeats(docs: DataFrame, keep_text: bool = False, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of docs (doc_id, text): sizes and digest after removal, and (keep_text) the kept bytes.

    Of equal texts only the smallest doc_id's goes through the blocks. The others lose everything from 50 bytes on:
    the first one holds all their strings. Rows without a doc_id are before all others, in an order of their own.
    """
    blocks = n_blocks(docs, block_docs)
    buckets = max(16, blocks // 4)
    texts = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("n_bytes"))
    firsts = hashed.groupBy("h").agg(F.min("doc_id").alias("first"))
    members = materialize(hashed.join(firsts, "h").select("doc_id", "n_bytes", "first", "h"), "texts")
    is_first = F.col("doc_id") == F.col("first")
    side = with_block(members.where(is_first).select("doc_id").distinct(), "doc_id", blocks).select("block", F.lit("first").alias("kind"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(None).cast("binary").alias("data"))
    by_block = with_block(texts, "doc_id", blocks).groupBy("block")
    repeated = by_block.cogroup(side.groupBy("block")).applyInPandas(_send_keys(buckets), PARCEL).groupBy("bucket").applyInPandas(_repeated_keys, ANSWER)
    parts = by_block.cogroup(side.unionByName(repeated).groupBy("block")).applyInPandas(_send_segments(buckets), PARCEL)
    judged = parts.groupBy("bucket").applyInPandas(_judge, ANSWER)
    done = by_block.cogroup(side.unionByName(judged).groupBy("block")).applyInPandas(_remove(keep_text), RESULT + (", kept binary" if keep_text else ""))
    # every row of a first document gets its one result; the copies' results follow from their size
    own = members.where(is_first).groupBy("doc_id").agg(F.count("*").alias("_n"))
    done = done.join(own, "doc_id").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_i")
    lost = F.col("n_bytes") >= LENGTH
    copies = members.where(~is_first).select("doc_id", "n_bytes", F.when(lost, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(lost, 1).otherwise(0).cast("long").alias("n_spans"), F.when(lost, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("h")).alias("kept_sha256"))
    if keep_text:
        short = texts.where(F.octet_length("text") < LENGTH).select("doc_id", F.col("text").cast("binary").alias("kept")).dropDuplicates(["doc_id"])
        copies = copies.join(short, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit("").cast("binary")))
    return done.unionByName(copies).withColumn("doc_id", real_id())


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
