"""Merging, differences, dedup by title, expiry, folding of access logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_sources(**dfs: DataFrame) -> DataFrame:
    """All rows under one schema with their source's name; columns a source lacks are null."""
    tagged = [df.withColumn("merged_from", F.lit(name)) for name, df in dfs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def name_diff(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """name and side of the names of one side only: missing (left only) or extra (right only)."""
    a, b = left.select(name).distinct(), right.select(name).distinct()
    missing = a.join(b, name, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, name, "left_anti").withColumn("side", F.lit("extra")))


def cell_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, left_value, right_value for every cell that differs; rows of one side differ in all set cells."""
    values = [c for c in left.columns if c not in keys and c in right.columns]

    def cells(df: DataFrame, side: str) -> DataFrame:
        entry = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in values])).alias("e")
        return df.select(*keys, entry).select(*keys, "e.column", F.col("e.v").alias(side))

    j = cells(left, "left_value").join(cells(right, "right_value"), [*keys, "column"], "full_outer")
    return j.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def title_key(title: Column | str) -> Column:
    return F.regexp_replace(F.lower(title), r"\s+", "")


def dedup_title(df: DataFrame, title: str, order: str) -> DataFrame:
    """One row per title without case and spaces: the first by `order`."""
    best = df.groupBy(title_key(title).alias("_k")).agg(F.min_by(F.struct(*df.columns), F.struct(order, *[c for c in df.columns if c != order])).alias("r"))
    return best.select("r.*")


def expire(memories: DataFrame, now: Column, max_age_days: int, tier: str = "free") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): past expires_at, or of the tier and older than so many days."""
    old = (F.col("tier") == tier) & (F.col("ts") < now - F.expr(f"INTERVAL {max_age_days} DAYS"))
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False)) | F.coalesce(old, F.lit(False))
    return memories.where(~gone), memories.where(gone)


def fold_access(memories: DataFrame, access_log: DataFrame) -> DataFrame:
    """Adds the log's accesses to accessed_count and last_accessed (memory_id, ts)."""
    log = access_log.groupBy("memory_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_t"))
    j = memories.join(log, "memory_id", "left")
    return j.withColumns({"accessed_count": (F.coalesce("accessed_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long"), "last_accessed": F.greatest("last_accessed", "_t")}).drop("_n", "_t")
