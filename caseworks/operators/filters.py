"""Filters and plain look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_items(df: DataFrame, project: str | None = None, status: str | None = None, assignee: str | None = None, type: str | None = None, title: str | None = None, has_subtasks: bool | None = None) -> DataFrame:
    """Work items by exact project, status, assignee and type, title words in any case, and whether subtasks exist."""
    exact = {"project": project, "status": status, "assignee": assignee, "type": type}
    for name, value in exact.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if title is not None:
        df = df.where(F.lower("title").contains(title.lower()))
    if has_subtasks is not None:
        df = df.where((F.coalesce("subtasks", F.lit(0)) > 0) == has_subtasks)
    return df


def filter_memories(df: DataFrame, owner: str | None = None, session: str | None = None, type: str | None = None, since: Column | None = None, min_importance: float | None = None, order: str = "ts", limit: int | None = None) -> DataFrame:
    """Memories by owner, session, type, time and importance, greatest `order` first, ties by id."""
    for name, value in (("owner", owner), ("session_id", session), ("memory_type", type)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if since is not None:
        df = df.where(F.col("ts") >= since)
    if min_importance is not None:
        df = df.where(F.col("importance") >= min_importance)
    df = df.orderBy(F.desc(order), "memory_id")
    return df.limit(limit) if limit is not None else df


def filter_feedback(df: DataFrame, type: str | None = None, category: str | None = None, since: Column | None = None, last_n: int | None = None) -> DataFrame:
    if type is not None:
        df = df.where(F.col("type") == type)
    if category is not None:
        df = df.where(F.col("category") == category)
    if since is not None:
        df = df.where(F.col("ts") >= since)
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(last_n) if last_n is not None else df


def find_entities(nodes: DataFrame, type: str | None = None, where: dict[str, str] | None = None, tag: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Nodes (id, type, properties map, tags, ts) of a type, with a tag and all key=value pairs; newest first."""
    if type is not None:
        nodes = nodes.where(F.col("type") == type)
    if tag is not None:
        nodes = nodes.where(F.array_contains("tags", tag))
    for k, v in (where or {}).items():
        nodes = nodes.where(F.try_element_at("properties", F.lit(k)) == v)
    if limit is None and not offset:
        return nodes
    nodes = nodes.orderBy(F.desc("ts"), "id").offset(offset)
    return nodes.limit(limit) if limit is not None else nodes


def latest_logs(df: DataFrame, key: str, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The latest n rows of each key. Spark keeps n per key and task before it shuffles."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recent(df: DataFrame, now: Column, hours: int, ts: str = "ts") -> DataFrame:
    return df.where((F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= now))
