"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items.

Texts are normalised (A-Z to lower case, words joined by one space), so that a window is a plain string between spaces;
one pass over a document finds every window of every item. Hits are mapped back to word numbers and to offsets of the
original text.

Defined results: null or wordless documents have no words and no hits; null or wordless items have no windows; an item
that occurs twice under two ids counts twice; an empty benchmark leaves every document clean; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseworks.llm.common import materialize, renamed, table

WINDOW = 10
#: Test items are held in one automaton up to so many bytes of text (which take some 450 MB); a larger benchmark is scanned
#: in as many rounds.
ROUND_BYTES = 1 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normalise(text: str | None) -> str:
    """Words in lower case with one space before and after each; a lone space if there are none."""
    if not text:
        return " "
    text = _GAP.sub(" ", text.lower() if text.isascii() else text.translate(_LOWER))
    return (text if text.startswith(" ") else " " + text) + ("" if text.endswith(" ") else " ")


def windows(text: str | None, n: int = WINDOW) -> set[str]:
    words = normalise(text).split(" ")[1:-1]
    return {" " + " ".join(words[i : i + n]) + " " for i in range(max(1, len(words) - n + 1))} if words and words != [""] else set()


def automaton(items: list[tuple[int, str | None]], n: int = WINDOW) -> ahocorasick.Automaton:
    """Value of a window: its number of words and the items that hold it."""
    holders: dict[str, set[int]] = defaultdict(set)
    for item, text in items:
        for w in windows(text, n):
            holders[w] |= set() if item is None else {item}
    a = ahocorasick.Automaton()
    for w, ids in holders.items():
        a.add_word(w, (w.count(" ") - 1, len(w), tuple(sorted(ids))))
    if holders:
        a.make_automaton()
    return a


def hits(text: str | None, a: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit runs as [first, last) word numbers, items with occurring windows."""
    norm = normalise(text)
    n_words = norm.count(" ") - 1 if len(norm) > 1 else 0
    runs, items, spaces = [], set(), None
    for end, (size, length, ids) in a.iter(norm) if len(a) and n_words else ():
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        first = int(np.searchsorted(spaces, end - length + 1))
        runs.append((first, first + size))
        items.update(ids)
    merged: list[tuple[int, int]] = []
    for a0, b0 in sorted(runs):
        if merged and a0 <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b0, merged[-1][1]))
        else:
            merged.append((a0, b0))
    return n_words, merged, items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


SCAN = "n_words long, runs array<struct<first:long,last:long>>, items array<{item}>, spans array<struct<start:long,end:long>>"
#: Columns that a scan adds, in place of those of these names.
ADDED = ("n_words", "runs", "items", "spans")


#: The automaton that this worker built last, by the name of its scan: tasks of one scan share it.
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton_of(name: str, items: list[tuple[int, str | None]]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = automaton(items)
    return _built[name]


def _scan(docs: DataFrame, items: list[tuple[int, str | None]], keep: list[str], item: str) -> DataFrame:
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton_of(name, items)
        for pdf in batches:
            found = [hits(t, a) for t in pdf["text"]]
            yield pdf[keep].assign(
                n_words=[f[0] for f in found],
                runs=[[{"first": x, "last": y} for x, y in f[1]] for f in found],
                items=[sorted(f[2]) for f in found],
                spans=[[{"start": x, "end": y} for x, y in original_spans(t, f[1])] for t, f in zip(pdf["text"], found, strict=True)],
            )

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(list(dict.fromkeys([*keep, "text"]))).mapInPandas(scan, f"{head}, {SCAN.format(item=item)}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The `keep` columns, n_words, runs, items and spans of every document.

    The benchmark's size is checked: up to `round_bytes` of text it is one automaton that every task builds; beyond
    that the items are dealt to rounds of that size, each with its own automaton, and the rounds' hits are merged. Item ids
    are of any simple type; an item without an id hits words, but can't be listed. Kept columns named as one that is added
    give way to it.
    """
    bench, kind = benchmark.select("item_id", "text"), benchmark.schema["item_id"].dataType.simpleString()
    keep = [c for c in keep if c not in ADDED]
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    if rounds == 1:
        return _scan(docs, [(r.item_id, r.text) for r in bench.collect()], keep, kind)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # numbered once for all rounds
    parts = None
    for k in range(rounds):
        items = [(r.item_id, r.text) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).collect()]
        part = _scan(rows, items, [*keep, "_row"], kind)
        parts = part if parts is None else parts.unionByName(part)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = parts.groupBy("_row", *keep).agg(F.max("n_words").alias("n_words"), flat("runs"), flat("items"), flat("spans"))
    empty = lambda a, b, c: f"CAST(array() AS array<struct<{a}:long,{b}:long>>)"
    join = lambda c, a, b: F.expr(  # noqa: E731  runs in order, touching ones joined
        f"aggregate({c}, {empty(a, b, c)}, (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).{b} >= x.{a} "
        f"THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('{a}', element_at(acc, -1).{a}, '{b}', greatest(element_at(acc, -1).{b}, x.{b})))) ELSE concat(acc, array(x)) END)"
    )
    return merged.withColumn("runs", join("runs", "first", "last")).withColumn("spans", join("spans", "start", "end")).drop("_row")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any hit word go; all others stay as they are, null and empty texts and repeated rows too. Extra
    columns may have any name, an empty table stays empty, an empty benchmark takes nothing."""
    plain = renamed(docs)
    found = find_contamination(plain, table(spark, sf_dir, "benchmark"), plain.columns)
    return found.where(F.size("items") == 0).select(plain.columns).toDF(*docs.columns)


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, w[i:i + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] AS win
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
