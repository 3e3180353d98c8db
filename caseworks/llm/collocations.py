"""Phrase collocations of every language, counted in weighted acyclic automata.

1. Blocks: the documents that a task reads in a row are cut into pieces and words, once. A word stands for itself in its
   language, so languages never mix. The words with a count of LEAST or more over all blocks are the frequent ones, and get
   numbers. A phrase with such a count has frequent words only, and frequent pairs of neighbours, so nothing else is counted
   further: exact, as with any level-wise count.
2. Each block sorts its pairs of frequent words, then its runs of three and four words whose pairs are all frequent, and
   builds count transducers of them (transducer.py), one for each range of prefixes (of three words at most). In a range
   the blocks' transducers are united, their weights summed, and phrases under LEAST pruned. Below a prefix of three words
   stand at most as many phrases as there are frequent words, however common the prefix is.
3. Parts: each candidate asks for the counts of its parts, at every cut. The parts asked of a range are an automaton, which
   is composed with the range's transducer. The longest part but one word also brings the longer phrase's count, so the
   range knows which phrases a longer one covers (checking one word more is enough: a phrase between has a count between).
4. Scores, with decimals (products pass 64 bits), the lowest cut, and each language's first TOP, in DataFrame functions.

Blocks send parcels: one packed row for each range that gets any, never more rows than phrases. Nothing but a number of
bytes comes to the driver.

Defined results: null texts are empty, null langs are 'und'; repeated rows count as often; texts of any length are cut
whole, and no phrase crosses documents or pieces; ties in score and count go by the phrase's bytes; a corpus without any
candidate, or an empty table, gives no rows; extra columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseworks.llm import transducer
from caseworks.llm.bytewords import byte_class, parts, words
from caseworks.llm.common import fits, materialize, table
from caseworks.llm.exchange import among
from caseworks.llm.hashing import mix, word_hashes
from caseworks.llm.transducer import Transducer

LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: A longer phrase covers a part of it from this share of its count on, in hundredths.
COVER = 80
BLOCK_DOCS = 4000
BLOCK_CHARS = 8 << 20
#: Bytes of text for each range of prefixes.
RANGE_BYTES = 32 << 20
SPACES = byte_class((0x20, 0x20), (0x09, 0x09))
BREAKS = byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))

_NEXT = np.uint64(0x9E3779B97F4A7C15)
PARCEL = "kind string, at int, block long, data binary"


def path_key(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, from the numbers of its words."""
    key = columns[0]
    with np.errstate(over="ignore"):
        for c in columns[1:]:
            key = mix(key * _NEXT + c)
    return key


def range_of(phrases: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each phrase (rows of word numbers, 0: no word): a single word's, or that of the key of its first three."""
    key = single = (phrases[:, 0] - np.uint64(1)) % np.uint64(ranges)
    for c in range(1, min(3, phrases.shape[1])):
        before = phrases[:, 0] if c == 1 else key
        key = np.where(phrases[:, c] > 0, path_key([before, phrases[:, c]]), key)
    longer = phrases[:, 1] > 0 if phrases.shape[1] > 1 else np.zeros(len(phrases), bool)
    return np.where(longer, _slot(key, ranges), single.astype(np.int64))


def _slot(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _packed(codes: np.ndarray) -> bytes:
    """Numbers of a word each, byte by byte, which compresses better."""
    return transducer.squeeze(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(transducer.unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _parcels(kind: str, block: int, at: np.ndarray, content: Callable[[np.ndarray], bytes]) -> pd.DataFrame:
    """A row for each range that occurs in `at`, with content(the places there)."""
    order = np.argsort(at, kind="stable")
    runs = [p for p in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(p)]
    out = pd.DataFrame({"kind": kind, "at": [int(at[p[0]]) for p in runs], "block": block, "data": [content(p) for p in runs]})
    return out.astype({"kind": object, "at": "int32", "block": "int64", "data": object})


def _blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """kind 'own': a block's words in a row; 'words': its distinct words for a range; 'n': words of a language (its name is
    in data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for pdf in batches:
            texts, names = pdf["text"].tolist(), pdf["lang"].fillna("und").to_numpy()
            for a, b in parts(texts, BLOCK_DOCS, BLOCK_CHARS):
                block += 1
                cut = words(texts[a:b], SPACES | BREAKS, b"\n")
                langs, of = np.unique(names[a:b].astype(str), return_inverse=True)
                of = np.repeat(of, cut.sizes)
                hashes = mix(cut.hash ^ np.array([_name_hash(x) for x in langs], np.uint64)[of]) | np.uint64(1)
                codes, keys = pd.factorize(hashes)
                piece = np.cumsum(BREAKS[cut.raw])[cut.start]
                joined = np.concatenate([[False], piece[1:] == piece[:-1]])[: len(codes)]
                first = np.zeros(len(keys), np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                counts = np.bincount(codes, minlength=len(keys))
                yield pd.DataFrame({"kind": "own", "at": -1, "block": block, "data": [pickle.dumps((_packed(codes), keys, np.packbits(joined)), 5)]})
                yield pd.DataFrame({"kind": "n", "at": np.bincount(of, minlength=len(langs)), "block": block, "data": [x.encode() for x in langs]})
                strings = lambda p: b"\n".join(cut.word(i) for i in first[p])  # noqa: B023, E731
                yield _parcels("words", block, _slot(keys, ranges), lambda p: transducer.squeeze(pickle.dumps((keys[p], transducer.narrow(counts[p]), transducer.narrow(of[first[p]]), langs.tolist(), strings(p)), 5)))  # noqa: B023

    return docs.select("text", "lang").mapInPandas(run, PARCEL)


def _name_hash(lang: str) -> int:
    """A number for a language's name, which may hold spaces."""
    return int(word_hashes([lang.encode("utf-8", "surrogatepass").hex() or "-"])[0])


def _frequent_words(ranges: int):
    """Numbers the range's frequent words. To each block ('answer') which of the words that it sent are frequent and their
    numbers; the range's transducer ('counts') and the names of its words ('names')."""

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [pickle.loads(transducer.unsqueeze(x)) for x in pdf["data"]]
        at = int(pdf["at"].iloc[0])
        keys, which = np.unique(np.concatenate([k for k, *_ in got]), return_inverse=True)
        total = np.bincount(which, np.concatenate([n for _, n, *_ in got]), len(keys)).astype(np.int64)
        frequent, named, out, done = total >= LEAST, {}, [], 0
        place = np.cumsum(frequent) - 1
        numbers = place.astype(np.uint64) * np.uint64(ranges) + np.uint64(at + 1)  # dense over all ranges
        for block, (k, _, of, langs, strings) in zip(pdf["block"].tolist(), got, strict=True):
            own = which[done : done + len(k)]
            done += len(k)
            out.append(("answer", at, block, pickle.dumps((np.packbits(frequent[own]), place[own[frequent[own]]].astype(np.uint32)), 5)))
            new = [i for i in np.flatnonzero(frequent[own]).tolist() if own[i] not in named]
            if new:
                split = strings.split(b"\n")
                named |= {own[i]: (langs[of[i]], split[i]) for i in new}
        out.append(("counts", at, -1, transducer.of_phrases(numbers[frequent][:, None], total[frequent]).dump()))
        out.append(("names", at, -1, pickle.dumps([(int(numbers[i]), *named[i]) for i in np.flatnonzero(frequent).tolist()], 5)))
        return pd.DataFrame(out, columns=["kind", "at", "block", "data"]).astype({"kind": object})

    return number


def _united(depth: int, answer: bool):
    """The range's transducer of what the blocks sent, pruned, and the frequent phrases' keys for all blocks that have them."""

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [Transducer.load(x) for x in pdf["data"]]
        t = transducer.union(got, depth, LEAST)
        at = int(pdf["at"].iloc[0])
        out = [("counts", at, -1, t.dump())]
        if answer:
            for block, own in zip(pdf["block"].tolist(), got, strict=True):
                r, _ = transducer.compose(own, t, depth)
                if len(r):
                    found = own.words[r - 1]
                    out.append(("answer", at, block, path_key([found[:, c] for c in range(depth)]).tobytes()))
        return pd.DataFrame(out, columns=["kind", "at", "block", "data"]).astype({"kind": object})

    return unite


def _with_none(words: np.ndarray) -> np.ndarray:
    """Words by place: 0 for no word, then the words."""
    return np.concatenate([np.zeros(1, np.uint64), words])


class _Block:
    """A block's words in a row, as the numbers of the frequent ones (0: another word)."""

    def __init__(self, data: bytes, answers: pd.DataFrame, ranges: int) -> None:
        codes, keys, joined = pickle.loads(data)
        codes = _unpacked(codes)
        at, numbers = _slot(keys, ranges), np.zeros(len(keys), np.uint64)
        for r in answers.itertuples():
            bits, place = pickle.loads(r.data)
            own = np.flatnonzero(at == r.at)
            own = own[np.unpackbits(bits, count=len(own)).astype(bool)]
            numbers[own] = place.astype(np.uint64) * np.uint64(ranges) + np.uint64(r.at + 1)
        self.words = np.unique(numbers[numbers > 0])
        self.number = numbers[codes]
        #: Places in self.words, from 1 (0: none).
        self.w = np.where(numbers > 0, np.searchsorted(self.words, numbers) + 1, 0)[codes]
        joined = np.unpackbits(joined, count=len(codes)).astype(bool)
        #: Whether a word and the next one are a pair of frequent words in one piece.
        self.pair = (self.w[:-1] > 0) & (self.w[1:] > 0) & joined[1:]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (rows of word numbers) and their counts."""
        at = np.flatnonzero(self.pair)
        rows, counts = transducer.summed(np.stack([self.w[at], self.w[at + 1]], 1), np.ones(len(at), np.int64), len(self.words))
        return _with_none(self.words)[rows], counts

    def longer(self, frequent_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three and of four words whose pairs are all frequent, and their counts."""
        w, at = self.w, np.flatnonzero(self.pair)
        good = np.zeros(len(w) + 2, bool)
        good[at] = among(path_key([self.number[at], self.number[at + 1]]), frequent_pairs) if len(at) else False
        at = np.flatnonzero(good[:-2] & good[1:-1])
        last = np.where(good[at + 2], w[np.minimum(at + 3, len(w) - 1)], 0)
        rows, counts = transducer.summed(np.stack([w[at], w[at + 1], w[at + 2], last], 1), np.ones(len(at), np.int64), len(self.words))
        shorter = rows.copy()
        shorter[:, 3] = 0
        four = rows[:, 3] > 0
        rows, counts = transducer.summed(np.concatenate([rows[four], shorter]), np.concatenate([counts[four], counts]), len(self.words))
        return _with_none(self.words)[rows], counts


def _send(kind: str, ranges: int):
    """A block's transducers of pairs, or of longer phrases, for the ranges of prefixes."""

    def send(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = [_parcels(kind, 0, np.zeros(0, np.int64), bytes)]
        for block, data in zip(own["block"].tolist(), own["data"], strict=True):
            held = _Block(data, answers[answers["kind"] == "words"], ranges)
            if kind == "pairs":
                phrases, counts = held.pairs()
            else:
                told = answers["data"][answers["kind"] == "pairs"]
                phrases, counts = held.longer(np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in told]])))
            out.append(_parcels(kind, block, range_of(phrases, ranges), lambda p: transducer.of_phrases(phrases[p], counts[p]).dump()))  # noqa: B023
        return pd.concat(out)

    return send


def _ask(ranges: int):
    """For every candidate of a range and every cut of it, its parts, sent to their ranges."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                t = Transducer.load(data)
                rows, a = t.paths(MOST_WORDS)
                rows = _with_none(t.words)[rows]
                length = (rows > 0).sum(1)
                asked = []
                for m in range(2, MOST_WORDS + 1):
                    own = np.flatnonzero(length == m)
                    for k in range(1, m):
                        for right in (0, 1):
                            part = np.zeros((len(own), 3), np.uint64)
                            take = rows[own][:, k:m] if right else rows[own][:, :k]
                            part[:, : take.shape[1]] = take
                            asked.append((part, own, np.full(len(own), 2 * k + right), np.full(len(own), take.shape[1] == m - 1)))
                part, own, cut, near = (np.concatenate(x) for x in zip(*asked, strict=True))
                yield _parcels("asked", 0, range_of(part, ranges), lambda p: pickle.dumps((part[p], rows[own[p]], a[own[p]], cut[p].astype(np.int8), near[p]), 5))  # noqa: B023

    return ask


PARTS = "p1 long, p2 long, p3 long, p4 long, a long, cut int, f long, covered boolean"


def _look_up(counts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The count f of each part that is asked for: rows of the candidate (p1 to p4), its count a, and the cut (twice the
    words before it, 1 more for the right part). Rows of a phrase that a longer one covers have `covered` and no cut."""
    held = [Transducer.load(x) for x in counts["data"]]
    if not len(asked):
        return _part_rows(np.zeros((0, 4), np.uint64), *[np.zeros(0, np.int64)] * 4)
    part, phrase, a, cut, near = (np.concatenate(x) for x in zip(*[pickle.loads(x) for x in asked["data"]], strict=True))
    t = transducer.of_phrases(part, np.ones(len(part), np.int64))
    own = np.where(part > 0, np.searchsorted(t.words, part) + 1, 0)
    rows, which = np.unique(own, axis=0, return_inverse=True)
    found, f = zip(*[transducer.compose(t, x, 3) for x in held], strict=True) if held else ([np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)])
    found, f = np.concatenate(found), np.concatenate(f)
    order = np.lexsort(found.T[::-1])
    assert len(found) == len(rows) and (found[order] == rows).all(), "every part of a candidate is counted"
    f = f[order]
    longer = np.zeros(len(rows), np.int64)
    np.maximum.at(longer, which[near], a[near])
    gone = np.flatnonzero((100 * longer >= COVER * f) & (rows[:, 1] > 0))
    phrases = _with_none(t.words)[rows[gone]]
    covered = _part_rows(np.pad(phrases, ((0, 0), (0, 1))), f[gone], np.zeros(len(gone)), f[gone], np.ones(len(gone)))
    return pd.concat([_part_rows(phrase, a, cut, f[which], np.zeros(len(a))), covered])


def _part_rows(phrases: np.ndarray, a: np.ndarray, cut: np.ndarray, f: np.ndarray, covered: np.ndarray) -> pd.DataFrame:
    signed = phrases.view(np.int64).reshape(-1, 4)
    out = pd.DataFrame({f"p{i + 1}": signed[:, i] for i in range(4)})
    return out.assign(a=a, cut=cut.astype(np.int32), f=f, covered=covered.astype(bool))


def _names(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for data in pdf["data"]:
            rows = pickle.loads(data)
            yield pd.DataFrame({"h": np.array([r[0] for r in rows], np.int64), "lang": [r[1] for r in rows], "word": [r[2].decode("utf-8", "surrogatepass") for r in rows]}).astype({"lang": object, "word": object})


def _scored(rows: DataFrame) -> DataFrame:
    """p1 to p4, a, score, l, r of the candidates that no longer phrase covers."""
    phrase = [f"p{i}" for i in range(1, 5)]
    of = lambda code: F.max(F.when(F.col("cut") == code, F.col("f")))
    sides = [of(2 * k + right).alias(f"f{k}{right}") for k in range(1, MOST_WORDS) for right in (0, 1)]
    g = rows.groupBy(*phrase).agg(F.max("a").alias("a"), F.max("covered").alias("covered"), *sides).where("NOT covered")
    cut = lambda k: F.when(F.col(f"f{k}0").isNotNull(), F.struct(_score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")))
    best = F.array_min(F.filter(F.array(*[cut(k) for k in range(1, MOST_WORDS)]), lambda x: x.isNotNull()))
    return g.withColumn("best", best).select(*phrase, "a", "best.score", "best.l", "best.r")


def _score(k: int) -> Column:
    return F.expr(f"(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(f{k}0 AS DECIMAL(19,0)) + CAST(f{k}1 AS DECIMAL(19,0)))")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (text, lang): each language's first `top` phrases."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(4, -(-size // RANGE_BYTES))
    cut = materialize(_blocks(docs, ranges), "phrase-blocks", "kind")
    own = cut.where("kind = 'own'").select("block", "data")
    sent = lambda df: df.groupBy("at")
    answers = lambda df, kind: df.where("kind = 'answer'").select(F.lit(kind).alias("kind"), "at", "block", "data")
    ones = materialize(sent(cut.where("kind = 'words'")).applyInPandas(_frequent_words(ranges), PARCEL), "phrase-words", "kind")
    told = answers(ones, "words")
    pairs = own.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_send("pairs", ranges), PARCEL)
    twos = materialize(sent(pairs).applyInPandas(_united(2, True), PARCEL), "phrase-pairs", "kind")
    told = told.unionByName(answers(twos, "pairs"))
    longer = own.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_send("longer", ranges), PARCEL)
    more = materialize(sent(longer).applyInPandas(_united(MOST_WORDS, False), PARCEL), "phrases", "kind")
    counts = [x.where("kind = 'counts'").select("at", "data") for x in (ones, twos, more)]
    asked = counts[1].unionByName(counts[2]).select("data").mapInPandas(_ask(ranges), PARCEL)
    found = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("at").cogroup(sent(asked)).applyInPandas(_look_up, PARTS)
    names = materialize(ones.where("kind = 'names'").select("data").mapInPandas(_names, "h long, lang string, word string"), "phrase-names")
    return _ranked(_scored(found), names, cut.where("kind = 'n'").groupBy(F.col("data").cast("string").alias("lang")).agg(F.sum("at").alias("n")), top)


def _ranked(scored: DataFrame, names: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The phrases' words are fetched for those that may be among the first only; ties of the last one are kept for that."""
    order = [F.desc("score"), F.desc("a")]
    with_lang = scored.join(fits(names.select(F.col("h").alias("p1"), "lang")), "p1")
    near = with_lang.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    for i in range(1, MOST_WORDS + 1):
        near = near.join(fits(names.select(F.col("h").alias(f"p{i}"), F.col("word").alias(f"w{i}"))), f"p{i}", "left")
    phrase = F.concat_ws(" ", *[f"w{i}" for i in range(1, MOST_WORDS + 1)])
    ranked = near.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
tok AS (SELECT lang, w, len(w) AS c FROM p WHERE len(w) > 0),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM tok GROUP BY 1),
g AS (SELECT lang, m, w[i:i + m - 1] AS ph FROM (SELECT lang, w, m, unnest(range(1, c - m + 2)) AS i FROM tok, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE c >= m)),
f AS (SELECT lang, ph, len(ph) AS m, count(*)::BIGINT AS a FROM g GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
c AS (SELECT lang, ph, m, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.ph, c.m, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
covered AS (SELECT DISTINCT o.lang, sub FROM (SELECT lang, a, ph[i:i + q - 1] AS sub FROM (SELECT lang, ph, a, m, q, unnest(range(1, m - q + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS q) WHERE q < m)) o
  JOIN f ON f.lang = o.lang AND f.ph = o.sub WHERE 100::HUGEINT * o.a >= {COVER} * f.a),
kept AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM b ANTI JOIN (SELECT lang, sub AS ph FROM covered) z USING (lang, ph)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN total USING (lang) WHERE rank <= {TOP}
"""
