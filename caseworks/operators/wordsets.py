"""Pairs of similar sets of words, exactly, with little on disk.

Two sets whose Jaccard similarity is over t have more than q (n + m) words in common, q = t / (1 + t). In any order of all words
they share one among the first n - ceil(t n) + 1 of each (prefix filter); the first word that they share leaves as many words
as follow it. The order is that of a table of CELLS counts by a hash of the word, rare ones first: a table of a fixed size, so
words needn't meet their counts in a shuffle. Words are their 32-bit hashes until pairs are compared; words that share one only
make more candidates.

A block of sets sends a bucket of words one parcel: the words, and each set's size and bitmap once. In a bitmap each word flips a
bit, so two bitmaps differ in no more bits than the sets do in words; it has 1.5 bits a word at least, and a larger one is folded
to meet a smaller one. Candidates leave a bucket packed by tile (two groups of sets). A set's words go to the tiles that ask for
them, not to each of its pairs, so a group of many near copies travels as its sets and not as its pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.plans.shared import written
from caseworks.plans.sizes import few

#: Counts that order the words; SLICES parts of them are summed apart.
CELLS, SLICES = 1 << 20, 64
#: Words that a block holds, that a bucket gets on average and takes at once; pairs that are tried at once, and kept at most.
BLOCK_WORDS, BUCKET_WORDS, STRIP_WORDS, PAIRS, KEPT = 1 << 21, 2_500_000, 500_000, 1 << 20, 1 << 23
#: Sets of a group, of which a tile has two, and the most groups.
GROUP_SETS, GROUPS = 20_000, 128
#: Candidates of a tile, repeats counted, beyond which all are dealt to more groups.
TILE_PAIRS = 8_000_000
#: Rows (set, tile) that are broadcast at most; more are joined by shuffle.
ASKED = 500_000
PACKED = "tile int, ids array<long>, x binary, y binary"


def _mixed(keys: np.ndarray) -> np.ndarray:
    """The keys spread over 64 bits, the lower ones as good as the upper ones."""
    k = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def _longs(n: np.ndarray) -> np.ndarray:
    """Longs of the bitmap of a set of n words: a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(2, 1.5 * n / 64))).astype(np.int64)


def _thin(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, first all their lowest bytes and so on: the upper ones are mostly 0 and take no room when compressed."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers and sizes of the sets of a block, and all their keys in a row."""
    for pdf in batches:
        n = pdf["k"].str.len().to_numpy().astype(np.int64)
        block = np.cumsum(n) // BLOCK_WORDS
        for at in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
            if len(at):
                yield pdf["c"].to_numpy()[at], n[at], np.concatenate(pdf["k"].to_numpy()[at]).astype(np.int32).view(np.uint32)


def _counts(sets: DataFrame) -> np.ndarray:
    """How many sets' words fall into each cell."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(CELLS, np.int64)
        for _, _, keys in _blocks(batches):
            held += np.bincount(keys & np.uint32(CELLS - 1), minlength=CELLS)
        yield pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "data": [x.astype("<i4").tobytes() for x in np.split(held, SLICES)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": pdf["slice"][:1], "data": [sum(np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["data"]).tobytes()]})

    rows = sets.mapInPandas(count, "slice int, data binary").groupBy("slice").applyInPandas(add, "slice int, data binary").collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["data"], np.int64)
    return out.reshape(-1)


def _parcels(c: np.ndarray, n: np.ndarray, keys: np.ndarray, counts: np.ndarray, threshold: float, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, what a block has for it): ids, sizes and bitmaps of its sets, the words of their prefixes, whose and at which place."""
    who = np.repeat(np.arange(len(n)), n)
    longs = _longs(n)
    start = np.cumsum(longs) - longs
    mixed = _mixed(keys)
    bit = start[who] * 64 + (mixed & (longs[who].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    bits = np.packbits((np.bincount(bit, minlength=int(longs.sum()) * 64) & 1).astype(bool), bitorder="little").view("<u8")
    found = counts[keys & np.uint32(CELLS - 1)]
    order = np.lexsort((keys, found, who))
    place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    before = np.concatenate([keys[:1], keys[order[:-1]]])  # the word before it in its set, if the place isn't 0
    keep = np.maximum(n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1, 1)
    used = (place < keep[who]) & (found[order] > 1)  # the only word of its cell pairs nothing
    order, place, before = order[used], place[used], before[used]
    bucket = (mixed[order] >> np.uint64(40)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    for at in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(at):
            own, many = np.unique(who[order[at]], return_counts=True)  # in the order of the words
            m = longs[own]
            held = np.arange(m.sum()) + np.repeat(start[own] - (np.cumsum(m) - m), m)
            word = (mixed[order[at]] >> np.uint64(8)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            yield int(bucket[at[0]]), pickle.dumps((c[own], bits[held], word.tobytes(), _thin(n[own]), _thin(many), _thin(place[at]), before[at]), 5)


def _opened(data: bytes) -> tuple[np.ndarray, ...]:
    """Ids, sizes and bitmaps of a parcel's sets; words, whose, at which place and after which word."""
    c, bits, packed, n, many, place, before = pickle.loads(data)
    word = np.zeros((len(packed) // 3, 4), np.uint8)
    word[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return c, _wide(n).astype(np.int64), bits, word.view("<u4").reshape(-1), np.repeat(np.arange(len(c), dtype=np.int32), _wide(many)), _wide(place).astype(np.int32), before


class _Bitmaps:
    """Bitmaps of sets, each also folded to the sizes of those that it may meet."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, threshold: float) -> None:
        self.longs = _longs(n)
        start = np.cumsum(self.longs) - self.longs
        self.held, self.row = {}, {}
        for size in np.unique(self.longs).tolist():
            row, parts, total = np.full(len(n), -1, np.int32), [], 0
            most = n[self.longs == size].max()
            for larger in np.unique(self.longs[self.longs >= size]).tolist():
                own = np.flatnonzero((self.longs == larger) & (n * threshold <= most + 1))
                if len(own):
                    full = bits[(start[own][:, None] + np.arange(larger))]
                    parts.append(np.bitwise_xor.reduce(full.reshape(len(own), larger // size, size), axis=1))
                    row[own] = np.arange(total, total + len(own))
                    total += len(own)
            self.held[size], self.row[size] = np.concatenate(parts), row

    def differ(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of two sets each differ, in the size of the smaller one's."""
        out = np.zeros(len(small), np.int64)
        size = self.longs[small]
        for s in np.unique(size).tolist():
            at, held, row = np.flatnonzero(size == s), self.held[s], self.row[s]
            step = max(1, (1 << 21) // s)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                out[part] = np.bitwise_count(held[row[small[part]]] ^ held[row[large[part]]]).sum(1, dtype=np.int64)
        return out


def _meet(parcels: list[tuple], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of a bucket's sets, and the numbers of the sets of each candidate: once, unless they are too many to be held."""
    sizes = np.array([len(p[0]) for p in parcels])
    c, n, bits, keys, place, before = (np.concatenate([p[k] for p in parcels]) for k in (0, 1, 2, 3, 5, 6))
    who = np.concatenate([p[4] + np.int32(s) for p, s in zip(parcels, np.cumsum(sizes) - sizes, strict=True)])
    parcels.clear()
    bitmaps = _Bitmaps(n, bits, threshold)
    strips, codes, more, count = len(keys) // STRIP_WORDS + 1, np.zeros(0, np.int64), [], 0
    for strip in range(strips):
        at = np.flatnonzero(keys % np.uint32(strips) == strip)
        for found in _tried(n, bitmaps, keys[at], who[at], place[at], before[at], threshold):
            more.append(found)
            count += len(found)
            if count > 2 * PAIRS:
                codes, more, count = np.unique(np.concatenate([codes, *more])), [], 0
            if len(codes) > KEPT:
                yield c, codes // len(n), codes % len(n)
                codes = codes[:0]
    codes = np.unique(np.concatenate([codes, *more]))
    yield c, codes // len(n), codes % len(n)


def _tried(n: np.ndarray, bitmaps: _Bitmaps, keys: np.ndarray, who: np.ndarray, place: np.ndarray, before: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Candidates that meet on the words, some at a time, as the number of the one set times len(n) and that of the other. Two
    sets that have the word before in common too have met on that, so near copies meet on few of the words that they share."""
    order = np.lexsort((n[who], keys))
    keys, who, place, before = keys[order], who[order], place[order], before[order]
    size = n[who]
    left = size - place
    share = threshold / (1 + threshold)
    word = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])) * (int(n.max(initial=0)) + 1)
    low = np.flatnonzero(left >= 2 * share * size - 1e-6)  # only these may be a pair's smaller set (of the size of the other at most)
    key, small, room, last, lowest = (word + size)[low], who[low], (left - share * size)[low], before[low], place[low] == 0
    first = np.searchsorted(key, word + np.ceil(threshold * size - 1e-6).astype(np.int64), "left")
    most = np.minimum(size, np.floor((left + 1e-6) / share - size)).astype(np.int64)
    many = np.maximum(np.searchsorted(key, word + most, "right") - first, 0)
    ends = np.cumsum(many)
    for a, b in _runs(ends, PAIRS):
        m = many[a:b]
        i = np.arange(m.sum()) + np.repeat(first[a:b] - (ends[a:b] - m - (ends[a] - m[0])), m)
        close = np.flatnonzero(room[i] >= np.repeat(share * size[a:b] - 1e-6, m))
        i, j = i[close], np.repeat(np.arange(a, b), m)[close]
        new = (last[i] != before[j]) | lowest[i] | (place[j] == 0)
        x, y = small[i[new]], who[j[new]]
        once = (n[x] < n[y]) | (x < y)  # sets of one size meet in both roles
        x, y = x[once], y[once]
        both = n[x] + n[y]
        near = both - bitmaps.differ(x, y) >= 2 * (share * both - 1e-6)
        yield np.unique(x[near] * np.int64(len(n)) + y[near])


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with so many pairs in all, or one row."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _packed(c: np.ndarray, x: np.ndarray, y: np.ndarray, groups: int) -> Iterator[pd.DataFrame]:
    """Candidates by tile: the ids of its sets, and pairs as places among them."""
    group = (c.astype(np.uint64) % np.uint64(groups)).astype(np.int64)
    tile = np.minimum(group[x], group[y]) * groups + np.maximum(group[x], group[y])
    by = np.argsort(tile, kind="stable")
    for at in np.split(by, np.flatnonzero(np.diff(tile[by])) + 1):
        if len(at):
            own, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            yield pd.DataFrame({"tile": np.array([tile[at[0]]], np.int32), "ids": [c[own]], "x": [_thin(place[: len(at)])], "y": [_thin(place[len(at) :])]})


def candidates(sets: DataFrame, threshold: float, groups: int) -> DataFrame:
    """PACKED candidates among sets (c, w) of words, c told apart; a pair may come from several buckets. All pairs with a
    Jaccard similarity over the threshold are among them."""
    threshold = max(threshold, 1e-9)
    sets = sets.select("c", F.transform("w", lambda x: F.hash(x)).alias("k")).where(F.size("k") > 0)
    counts = _counts(sets)
    buckets = max(12, int(counts.sum() * (1 - threshold) / BUCKET_WORDS) + 1)
    order = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, n, keys in _blocks(batches):
            for bucket, data in _parcels(c, n, keys, order.value, threshold, buckets):
                yield pd.DataFrame({"bucket": np.array([bucket], np.int32), "data": [data]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for bucket, data in zip(pdf["bucket"], pdf["data"], strict=True):
                held.setdefault(bucket, []).append(_opened(data))
        while held:
            for found in _meet(held.popitem()[1], threshold):
                yield from _packed(*found, groups)

    return sets.mapInPandas(send, "bucket int, data binary").repartitionById(buckets, "bucket").mapInPandas(meet, PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """c, d: the candidates one by one, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, x, y in zip(pdf["ids"], pdf["x"], pdf["y"], strict=True):
                c, d = np.asarray(ids)[_wide(x)], np.asarray(ids)[_wide(y)]
                yield pd.DataFrame({"c": np.minimum(c, d), "d": np.maximum(c, d)})

    return packed.mapInPandas(run, "c long, d long").distinct()


def _dealt(packed: DataFrame, groups: int) -> DataFrame:
    """The candidates, by tiles of so many groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, x, y in zip(pdf["ids"], pdf["x"], pdf["y"], strict=True):
                yield from _packed(np.asarray(ids), _wide(x), _wide(y), groups)

    return packed.mapInPandas(run, PACKED)


def close_pairs(words: DataFrame, threshold: float) -> DataFrame:
    """c, d, similarity of pairs of sets over the threshold, each once. words: (c, w), a table that is cheap to read, c told
    apart, w the set's words with blanks between. Candidates are written to the shared folder."""
    groups = min(GROUPS, max(4, words.count() // GROUP_SETS + 1))
    packed = written(candidates(words.select("c", F.split("w", " ").alias("w")), threshold, groups), "candidates", free=True)
    most = packed.groupBy("tile").agg(F.sum(F.octet_length("x") / 4).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > TILE_PAIRS:
        packed = written(_dealt(packed, min(1 << 15, groups * (int((most / TILE_PAIRS) ** 0.5) + 1))), "candidates", free=True)
    return _compared(packed, words, threshold)


def _compared(packed: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    asked = words.join(few(packed.select(F.col("tile").alias("at"), F.explode("ids").alias("c")).distinct(), ASKED), "c")

    def compare(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        c, number, ends = sets["c"].to_numpy(), {}, [0]
        held = np.zeros(int(sets["w"].str.count(" ").sum()) + len(c), np.int32)
        for w in sets["w"]:
            own = [number.setdefault(x, len(number)) for x in w.split(" ")]
            held[ends[-1] : ends[-1] + len(own)] = own
            ends.append(ends[-1] + len(own))
        order = np.argsort(c)
        codes, more, count = np.zeros(0, np.int64), [], 0
        for ids, x, y in zip(pairs["ids"], pairs["x"], pairs["y"], strict=True):
            at = order[np.searchsorted(c, np.asarray(ids), sorter=order)]
            x, y = at[_wide(x)], at[_wide(y)]
            more.append(np.unique(np.minimum(x, y) * len(c) + np.maximum(x, y)))
            count += len(x)
            if count > 2 * PAIRS:
                codes, more, count = np.unique(np.concatenate([codes, *more])), [], 0
        codes = np.unique(np.concatenate([codes, *more]))
        x, y = codes // max(len(c), 1), codes % max(len(c), 1)
        mark, both, last = np.zeros(len(number), bool), np.zeros(len(x)), -1
        for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            if a != last:
                if last >= 0:
                    mark[held[ends[last] : ends[last + 1]]] = False
                mark[held[ends[a] : ends[a + 1]]] = True
                last = a
            both[k] = np.count_nonzero(mark[held[ends[b] : ends[b + 1]]])
        n = np.diff(ends)
        similarity = both / (n[x] + n[y] - both)
        near = similarity > threshold
        return pd.DataFrame({"c": c[x[near]], "d": c[y[near]], "similarity": similarity[near]})

    return packed.groupBy("tile").cogroup(asked.groupBy("at")).applyInPandas(compare, "c long, d long, similarity double")
