"""Joins: look-ups, prices, statistics of collections, relations, impact windows, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseworks.operators.intervals import interval_join, outside
from caseworks.plans.sizes import small


def enrich(df: DataFrame, dim: DataFrame, key: str, values: list[str], fallback: Column | None = None) -> DataFrame:
    """Adds the dimension's values by key; a key without a row gets the fallback ('' where none is given).

    The dimension has one row per key. It is broadcast only if its estimated size is small.
    """
    joined = df.join(small(dim.select(key, *values)), key, "left")
    empty = F.lit("") if fallback is None else fallback
    return joined.withColumns({v: F.coalesce(v, empty) for v in values})


def price_usage(usage: DataFrame, prices: DataFrame, default_in: str = "0.002", default_out: str = "0.004") -> DataFrame:
    """Adds input_cost, output_cost and cost: tokens times the model's price per thousand, as decimals of six places."""
    money = T.DecimalType(10, 6)
    p = small(prices.select("model", F.col("input_price").cast(money).alias("pi"), F.col("output_price").cast(money).alias("po")))
    j = usage.join(p, "model", "left")
    cost = lambda n, price, default: F.round(F.col(n).cast("decimal(18,0)") * F.coalesce(price, F.lit(default).cast(money)) / F.lit(1000).cast("decimal(4,0)"), 6).cast("decimal(18,6)")
    j = j.withColumns({"input_cost": cost("prompt_tokens", "pi", default_in), "output_cost": cost("completion_tokens", "po", default_out)})
    return j.withColumn("cost", (F.col("input_cost") + F.col("output_cost")).cast("decimal(18,6)")).drop("pi", "po")


def collection_stats(collections: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per collection the number of documents, chunks and bytes; collections without any stay, with zeros.

    docs: collection, doc_id, size; chunks: doc_id, chunk_no. Both are summed before they meet, so nothing multiplies.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    d = docs.join(per_doc, "doc_id", "left").groupBy("collection").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_chunks"), F.sum("size").alias("bytes"))
    out = collections.join(d, "collection", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_docs", "n_chunks", "bytes")})


def related(nodes: DataFrame, edges: DataFrame, ids: DataFrame, rel: str | None = None, direction: str = "both") -> DataFrame:
    """Neighbours of ids (id): id, direction, rel, other and the other node's columns.

    The nodes are held, not the edges: an edge passes both joins unsorted, so a task's memory is its share of the nodes.
    """
    e = edges.where(F.col("rel") == rel).select("src", "dst") if rel else edges.select("src", "dst", "rel")
    ids, others = _held(ids.select("id")), _held(nodes.withColumnRenamed("id", "other"))
    parts = []
    for name, own, other in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (name, "both"):
            found = e.withColumnsRenamed({own: "id", other: "other"}).join(ids, "id", "left_semi").join(others, "other")
            found = found.withColumn("direction", F.lit(name))
            parts.append(found.withColumn("rel", F.lit(rel)) if rel else found)
    columns = [c for c in nodes.columns if c != "id"]
    return reduce(DataFrame.unionByName, parts).select("other", "id", "direction", "rel", *columns)


def _held(df: DataFrame) -> DataFrame:
    """df marked as the side of a join that is held in a hash table: whole if it is small, else by shares."""
    whole = small(df)
    return whole if whole is not df else df.hint("shuffle_hash")


def chunk_context(chunks: DataFrame, docs: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks with their document's and collection's columns."""
    return chunks.join(docs, "doc_id").join(small(collections), "collection")


def tracking_report(suggestions: DataFrame, tracking: DataFrame) -> DataFrame:
    """Every suggestion with its number of tracking rows, last phase and last time; none is 0 and null."""
    t = tracking.groupBy("suggestion_id").agg(F.count("*").alias("n_tracked"), F.max_by("phase", F.struct("ts", "phase")).alias("last_phase"), F.max("ts").alias("last_ts"))
    return suggestions.join(t, "suggestion_id", "left").withColumn("n_tracked", F.coalesce("n_tracked", F.lit(0)).cast("long"))


def impact(feedback: DataFrame, actions: DataFrame, before: str, after: str) -> DataFrame:
    """Per action (action_id, category, suggested_at, started_at) the mean value and count in the window before the
    suggestion and in the window after the start, and the change of the mean. Windows meet feedback by time bins, so a
    category with many actions and much feedback isn't their product."""
    a = actions.select("action_id", "category", "suggested_at", "started_at")
    window = lambda side, start, end: a.select("action_id", "category", F.lit(side).alias("side"), start.alias("w_from"), end.alias("w_to"))
    lo = window("before", F.col("suggested_at") - F.expr(f"INTERVAL {before}"), F.col("suggested_at"))
    hi = window("after", F.col("started_at"), F.col("started_at") + F.expr(f"INTERVAL {after}"))
    j = interval_join(feedback.select("category", "ts", "value"), lo.unionByName(hi), "category", "ts", "w_from", "w_to")
    cut = lambda side: (F.count(F.when(F.col("side") == side, 1)), F.avg(F.when(F.col("side") == side, F.col("value"))))
    (nb, mb), (na, ma) = cut("before"), cut("after")
    seen = j.groupBy("action_id").agg(nb.alias("n_before"), mb.alias("mean_before"), na.alias("n_after"), ma.alias("mean_after"))
    out = a.select("action_id", "category").join(seen, "action_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_before", "n_after")})
    return out.withColumn("change", F.col("mean_after") - F.col("mean_before"))


def drop_silenced(alerts: DataFrame, silences: DataFrame) -> DataFrame:
    """Alerts (name, ts, ...) that lie in no silence [from_ts, until_ts) of their name, by time bins."""
    return outside(alerts, silences, "name", "ts", "from_ts", "until_ts")


def pair_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Starts (run_id, task, started_at) with their finish (run_id, finished_at, status): seconds; without one running."""
    j = starts.join(finishes, "run_id", "left")
    seconds = F.unix_micros("finished_at") - F.unix_micros("started_at")
    return j.withColumns({"seconds": seconds / 1e6, "status": F.coalesce("status", F.lit("running"))})


def detect_changes(new: DataFrame, snapshot: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """keys and change: new, changed, unchanged or removed, by a full join on the keys and the hashes."""
    n = new.select(*keys, F.col(hash_col).alias("h_new"), F.lit(True).alias("in_new"))
    o = snapshot.select(*keys, F.col(hash_col).alias("h_old"), F.lit(True).alias("in_old"))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("h_new").eqNullSafe(F.col("h_old")), "unchanged").otherwise("changed")
    return n.join(o, keys, "full_outer").select(*keys, change.alias("change"))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the greatest version, an update before the base at the same version. One aggregation, no window."""
    both = base.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_u", *[c for c in rest if c != version])).alias("r"))
    return best.select(*keys, "r.*").select(base.columns)
