"""Joins of points with intervals on a line, without the product of a key's points and intervals.

An interval of length n belongs to the level of the least power of two not under n; at that level it touches two bins at
most. A point looks into its own bin at each level that occurs. So rows meet by key, level and bin: an interval is one or
two rows whatever its length, a point one row for each level, and a hot key is dealt by its bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseworks.plans.sizes import small


def _place(df: DataFrame, c: str) -> Column:
    """A whole number on the line: microseconds of times, numbers as they are."""
    kind = dict(df.dtypes)[c]
    return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(c).cast("long")


def _shift(place: Column, level: Column) -> Column:
    """floor(place / 2 ** level), for negative places too."""
    return F.call_function("shiftright", place, level)


def binned(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """intervals with _from, _to, _level and _bin: a row for each bin, two at most. Empty intervals and nulls have none."""
    i = intervals.withColumns({"_from": _place(intervals, start), "_to": _place(intervals, end)}).where("_from < _to")
    i = i.withColumn("_level", F.least(F.lit(62), F.length(F.bin(F.col("_to") - F.col("_from") - 1))).cast("int"))
    bins = F.array_distinct(F.array(_shift(F.col("_from"), F.col("_level")), _shift(F.col("_to") - 1, F.col("_level"))))
    return i.withColumn("_bin", F.explode(bins))


def levels(intervals: DataFrame) -> list[int]:
    """The levels of binned intervals: 63 numbers at most."""
    return sorted(r[0] for r in intervals.select("_level").distinct().collect())


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """points with each interval [start, end) of their key that they lie in; the intervals' columns but the key follow, which
    must have names of their own."""
    b = binned(intervals, start, end)
    p = points.withColumn("_at", _place(points, at)).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels(b)] or [F.lit(None).cast("int")])))
    p = p.withColumn("_bin", _shift(F.col("_at"), F.col("_level")))
    j = p.join(small(b), [key, "_level", "_bin"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    return j.select(*points.columns, *[c for c in intervals.columns if c != key])


def outside(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """points that lie in no interval [start, end) of their key: an anti-join for each level that occurs."""
    b = binned(intervals.select(F.col(key).alias("_key"), start, end), start, end)

    def without(p: DataFrame, level: int) -> DataFrame:
        own = small(b.where(F.col("_level") == level).select("_key", "_bin", "_from", "_to"))
        here = (p[key] == own["_key"]) & (_shift(p["_at"], F.lit(level)) == own["_bin"])
        return p.join(own, here & (p["_at"] >= own["_from"]) & (p["_at"] < own["_to"]), "left_anti")

    return reduce(without, levels(b), points.withColumn("_at", _place(points, at))).drop("_at")
