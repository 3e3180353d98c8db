"""Fuzzy line dedup by MinHash, in DataFrame functions only.

1. Texts are split at newlines; a line's id is the hash of its trimmed text, so equal lines are one.
2. Signatures are over the runs of eight bytes of the line in lower case, from every place (for ASCII these are
   characters). A line of many runs keeps those whose hash is 0 modulo a power of two, so that 32 to 64 are left: a
   choice by content, which no insertion moves. A line near the next power is signed at both. The power follows from the
   length, so a line that repeats a few runs over and over meets only lines of a similar length (a known loss).
3. Least hashes come from one aggregation that combines before it shuffles. Twelve bands of four, any two of which share
   one hash at most, are the buckets; in a bucket each line is tied to its leader.
4. Ties are verified by the exact Jaccard similarity of the sets of all runs of eight characters: each line with the
   leader it shares most buckets with, then, where components still differ, with its others. Buckets that still hold
   unverified pairs of different components go on (leftover.py).
5. Verified ties make components (alternating stars); the first place of each component is kept.

Defined results: null text has no lines and stays null; blank lines are kept and compared with nothing; lines of fewer
than MIN_CHARS characters are alike only if equal; a place is (doc_id, text, line number), so that equal rows count as
one document and lose the same lines, and of rows with one doc_id and different texts each loses its own; a null doc_id
is the least; an empty table gives no rows; extra columns are kept, but for those that dedup_lines adds under their name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseworks.llm.common import append, fits, materialize, table
from caseworks.llm.components import components, grown
from caseworks.llm.leftover import best_ties, resolve, ties
from caseworks.plans.shared import shared_dir

THRESHOLD = 0.8
#: Characters of a shingle. Shorter lines (after trimming) hold none and are compared by equality alone.
MIN_CHARS = 8
#: Hash functions, and the bands as numbers of four of them each: rows, columns and diagonals of a square.
MINS = 16
BANDS = [tuple(4 * i + (i * turn + b) % 4 for i in range(4)) for turn in (0, 1) for b in range(4)] + [tuple(range(4 * b, 4 * b + 4)) for b in range(4)]
#: A line's signature is of so many shingles at least (if it has them), of twice as many at most.
SIGNED = 32
#: Pairs that a task verifies (about a second a thousand), and tasks at most.
TASK_PAIRS, TASKS = 4000, 20_000
#: A row of a document, and the order of places.
PLACE = ["doc_id", "_row", "_no"]


def shingles(line: Column) -> Column:
    """Hashes of the distinct shingles of a line: its runs of eight characters, cut from four bytes a character."""
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (4 * MIN_CHARS - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(x, i, F.lit(4 * MIN_CHARS))))
    return F.transform(F.array(F.encode(F.lower(line), "utf-32")), lambda x: F.array_distinct(runs(x)))[0]  # bound to x, so encoded once


def with_row(docs: DataFrame) -> DataFrame:
    """docs with _row, which tells rows of one doc_id apart by their text."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _row, _no (from 0), trimmed line and its id; blank lines are left out."""
    lines = with_row(docs.select("doc_id", "text")).select("doc_id", "_row", F.posexplode(F.split("text", "\n", -1)).alias("_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line <> ''").withColumn("id", F.xxhash64("line"))


def band_rows(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(band, id) of every line long enough to be compared."""
    data = lines.where(F.length("line") >= MIN_CHARS).select("id", F.lower("line").cast("binary").alias("b"))
    runs = F.length("b") - (MIN_CHARS - 1)
    level = lambda n: F.greatest(F.lit(0), F.floor(F.log2(n / F.lit(SIGNED)))).cast("int")
    data = data.select("id", "b", level(runs).alias("own"), level(runs / F.lit(threshold)).alias("next"))  # once a line, so before explode
    each = data.select("id", "b", "own", "next", F.explode(F.sequence(F.lit(1), runs)).alias("at"))
    each = each.select("id", "own", "next", F.xxhash64(F.substring("b", F.col("at"), F.lit(MIN_CHARS))).alias("h"))
    chosen = lambda c: F.expr(f"h & (shiftleft(1L, {c}) - 1) = 0")
    each = each.where(chosen("own"))
    both = F.when((F.col("next") > F.col("own")) & chosen("next"), F.array("own", "next")).otherwise(F.array("own"))
    least = each.select("id", "h", F.explode(both).alias("level")).groupBy("id", "level").agg(*[F.min(F.hash("h", F.lit(k))).alias(f"m{k}") for k in range(MINS)])
    keys = F.array(*[F.xxhash64(F.lit(b), "level", *[F.col(f"m{k}") for k in of]) for b, of in enumerate(BANDS)])
    return least.select("id", F.explode(keys).alias("band"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (id, leader), written already, with their similarity. They are dealt evenly once their texts are there: a
    leader of many lines is one key of a join, and work is in the pairs, not in their bytes."""
    tasks = min(TASKS, pairs.count() // TASK_PAIRS + 1)
    other = texts.select(F.col("id").alias("leader"), F.col("line").alias("y"))
    dealt = pairs.join(texts, "id").join(other, "leader").repartition(tasks, "id", "leader")
    sets = dealt.select("id", "leader", shingles(F.col("line")).alias("x"), shingles(F.col("y")).alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return sets.select("id", "leader", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))


def similar_lines(lines: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified ties (id, leader) between lines, and the places (PLACE, id) of all lines."""
    links, _, places = _line_classes(lines, threshold)
    return links, places


def _line_classes(lines: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified ties (id, leader) between lines, their components (node, component), and the places (PLACE, id) of all lines.

    All rounds add their links to one Parquet folder, so plans stay as small as in the first round.
    """
    spark = lines.sparkSession
    tied = materialize(ties(band_rows(lines, threshold)), "line-ties")
    ids = materialize(tied.select("id").unionByName(tied.select(F.col("leader").alias("id"))).distinct().withColumn("named", F.lit(True)), "line-ids")
    places = materialize(lines.join(fits(ids), "id", "left").select(*PLACE, "id", F.when(F.col("named"), F.col("line")).alias("line")), "line-places")
    texts = materialize(places.where("line IS NOT NULL").groupBy("id").agg(F.first("line").alias("line")), "tied-lines")
    at = f"{shared_dir(spark)}/line-links-{uuid.uuid4().hex}"
    read = lambda: spark.read.schema("id long, leader long, similarity double").parquet(at)
    linked = lambda: read().where(F.col("similarity") >= threshold).select("id", "leader")
    found = None

    def parts() -> DataFrame:
        nonlocal found
        found = materialize(components(linked(), "id", "leader"), "parts") if found is None else grown(found, linked(), "id", "leader")
        return found

    verify = lambda pairs: append(_verified(materialize(pairs, "line-pairs"), texts), at)
    check = lambda pairs: verify(pairs.withColumnRenamed("member", "id").join(read().select("id", "leader"), ["id", "leader"], "left_anti"))
    verify(best_ties(tied).withColumnRenamed("member", "id"))
    made_of = lambda ids: texts.join(ids, "id").select("id", F.explode(shingles(F.col("line"))).alias("token"), F.lit(1.0).alias("weight"))
    resolve(tied, check, parts, made_of, threshold, unchecked=True)
    return linked(), parts(), places.select(*PLACE, "id")


def repeated_places(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """PLACE of every line that repeats, exactly or nearly, a line of an earlier place."""
    _, parts, places = _line_classes(document_lines(docs), threshold)
    places = places.join(fits(parts.withColumnRenamed("node", "id")), "id", "left").select(*PLACE, F.coalesce("component", "id").alias("class"))
    firsts = places.groupBy("class").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first")
    return places.join(fits(materialize(firsts, "first-places")), "class").where(~F.col("first").eqNullSafe(F.struct(*PLACE))).select(*PLACE)


def _with_gone(docs: DataFrame, threshold: float) -> DataFrame:
    """docs with _row and _gone, the numbers of its removed lines (null: none)."""
    gone = repeated_places(docs, threshold).groupBy("doc_id", "_row").agg(F.collect_set("_no").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("_row").alias("_key"), "_gone")
    rows = with_row(docs)
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["_doc"]) & (rows["_row"] == gone["_key"]), "left").drop(gone["_doc"]).drop(gone["_key"]).drop("_row")


def _kept_text() -> Column:
    """The text without the lines that _gone names."""
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i))
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda x: F.array_join(left(x), "\n"))[0]
    return F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the lines that repeat an earlier place's: n_lines, n_removed, clean added (in place of columns of
    these names)."""
    out = _with_gone(docs, threshold)
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return out.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines), "n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")), "clean": _kept_text()}).drop("_gone")


def op10_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("clean", F.lit("")), 256).alias("kept_sha256"))


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, texts change (and n_chars with them); a document that loses all its words goes too, any other
    stays. Null text stays null; equal rows change alike; extra columns of any name but _row and _gone stay as they are;
    an empty table stays empty."""
    out = _with_gone(docs, THRESHOLD).withColumn("text", _kept_text())
    out = out.where(F.col("_gone").isNull() | F.col("text").rlike(r"\S"))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)
