"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is tied to the least neighbour of that node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a leaf to a root, and each leaf has one. For distinct edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf > 1 OR leaf = 1 AND root = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(node, component) of all nodes with an edge; the component is its least node. Hubs are joined, never grouped."""
    edges = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "edges")
    for _ in range(max_rounds):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaf = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def grown(parts: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """The components of more edges, from the parts (node, component) of some of them: only edges between two parts make
    new rounds, over the parts as nodes. Where there is none, parts stays as it is."""
    of = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
    across = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    across = materialize(across.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")).where("u <> v").distinct(), "across")
    if across.isEmpty():
        return parts
    moved = components(across, "u", "v").select("node", F.col("component").alias("to"))
    kept = parts.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(parts.select("node"), "node", "left_anti").select("node", F.col("to").alias("component"))
    return materialize(kept.unionByName(new), "parts")
