"""Windows over time and order: first flags, growth, trends, moving values, quotas, recall, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseworks.plans.shared import cut_lineage
from caseworks.plans.sizes import few, small

from caseworks.functions import signals


def first_flag(df: DataFrame, key: str, order: str, name: str = "is_first") -> DataFrame:
    """1 on the first row of each key by `order`, else 0. Rows without a key are 0 and never meet in one task."""
    blank = F.col(key).isNull() | (F.col(key).cast("string") == "")
    salt = F.when(blank, F.xxhash64(order)).otherwise(F.lit(0))
    w = Window.partitionBy(key, salt).orderBy(order)
    return df.withColumn(name, F.when(blank, 0).otherwise(F.when(F.row_number().over(w) == 1, 1).otherwise(0)))


def kpi_growth(df: DataFrame, kpi: str, period: str, value: str, target: str) -> DataFrame:
    """Adds growth against the month and the year before, and completion of the target, in percent to one decimal.

    A missing or zero base gives 0. Months are matched by date, so gaps don't shift them.
    """
    base = df.select(kpi, F.col(period).alias("_p"), F.col(value).alias("_v"))
    out = df
    for name, months in (("mom", 1), ("yoy", 12)):
        prev = base.select(kpi, F.add_months("_p", months).alias(period), F.col("_v").alias(f"_{name}"))
        out = out.join(prev, [kpi, period], "left")
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(F.round(a / b * 100, 1))
    return out.select(*df.columns, ratio(F.col(value) - F.col("_mom"), F.col("_mom")).alias("mom"), ratio(F.col(value) - F.col("_yoy"), F.col("_yoy")).alias("yoy"), ratio(F.col(value), F.col(target)).alias("completion"))


RANGES = {"day": (24, "HOUR"), "week": (7, "DAY"), "month": (30, "DAY")}


def trend(feedback: DataFrame, now: Column, range: str = "week") -> DataFrame:
    """bucket, start, n, mean rating and positive share in 24 hours, 7 or 30 days up to now's, empty ones with 0.

    What is older falls into the first bucket (late data is counted, not dropped); what is after now is left out.
    Feedback is summed per bucket before it meets the list of buckets.
    """
    n, unit = RANGES[range]
    last = F.date_trunc(unit, now)
    start = last - F.expr(f"INTERVAL {n - 1} {unit}")
    seconds = 3600 if unit == "HOUR" else 86400
    at = F.floor((F.unix_timestamp(F.date_trunc(unit, "ts")) - F.unix_timestamp(start)) / seconds)
    f = feedback.where(F.col("ts") <= now).withColumn("bucket", F.greatest(F.lit(0), at).cast("int"))
    rated = F.when(F.col("type") == "explicit", signals.rating_value("rating"))
    g = f.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(rated).alias("mean_rating"), (F.count_if(F.col("sentiment") == "positive") / F.count("*")).alias("positive"))
    spine = feedback.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")).withColumn("start", start + F.make_interval(**{"hours" if unit == "HOUR" else "days": F.col("bucket")}))
    return spine.join(g, "bucket", "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "positive": F.coalesce("positive", F.lit(0.0))})


def trend_direction(trend: DataFrame) -> DataFrame:
    """direction and confidence: the mean count of the later half of the buckets against the earlier, 10 % either way."""
    t = trend.agg(F.count("*").alias("k"))
    j = trend.join(F.broadcast(t))  # one row
    late = F.col("bucket") >= F.floor(F.col("k") / 2)
    g = j.agg(F.avg(F.when(~late, F.col("n"))).alias("a"), F.avg(F.when(late, F.col("n"))).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    direction = F.when(b > a * 1.1, "increasing").when(b < a * 0.9, "decreasing").otherwise("stable")
    confidence = F.when(a == 0, F.when(b > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.abs(b - a) / a))
    return g.select(direction.alias("direction"), confidence.alias("confidence"))


def rating_decline(trend: DataFrame, last: int = 3, drop: float = 0.5) -> DataFrame:
    """One row: mean rating of the last rated buckets and of those before, and whether it fell by more than `drop`."""
    w = Window.orderBy(F.desc("bucket"))  # a trend has 30 rows at most
    r = trend.where("mean_rating IS NOT NULL").withColumn("_r", F.row_number().over(w))
    g = r.agg(F.avg(F.when(F.col("_r") <= last, F.col("mean_rating"))).alias("recent"), F.avg(F.when(F.col("_r") > last, F.col("mean_rating"))).alias("earlier"))
    return g.withColumn("declined", F.coalesce(F.col("earlier") - F.col("recent") > drop, F.lit(False)))


def ema(df: DataFrame, key: str, ts: str, value: str, alpha: float = 0.3, depth: int = 100) -> DataFrame:
    """Per key the exponential moving value in time order, starting from the first, and the last `depth` values.

    A value's weight follows from its place from the end, so the average is one sum over all rows of a key; only the
    last `depth` are gathered. Nulls are left out.
    """
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(value))
    rows = df.where(F.col(value).isNotNull()).select(key, F.struct(ts, F.col(value).cast("double").alias("v")).alias("_h"), (F.row_number().over(w) - 1).alias("_n"), F.lead(F.lit(1)).over(w).alias("_older"))
    weight = F.pow(F.lit(1 - alpha), F.col("_n")) * F.when(F.col("_older").isNull(), 1.0).otherwise(alpha)
    out = rows.groupBy(key).agg(F.sum(F.col("_h.v") * weight).alias("ema"), F.array_sort(F.collect_list(F.when(F.col("_n") < depth, F.col("_h")))).alias("_last"))
    return out.select(key, "ema", F.transform("_last", lambda x: x["v"]).alias("history"))


def _importance(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == 0), 0.5).otherwise(F.col(c))


def _recency(ts: str, now: Column) -> Column:
    age = (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400
    return F.greatest(F.lit(0.0), 1 - age / 90)


def _access(c: str) -> Column:
    return F.least(F.coalesce(c, F.lit(0)), F.lit(100)) / 100


#: Cells of a score's range that quotas are first cut by.
SCORE_CELLS = 4096


def rank_within(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df with rank: the place of each row in its key's order, from 1. The order should tell all rows of a key apart.

    Rows are dealt by ranges of key and order, ranked inside their range, and moved on by the numbers of the ranges before:
    a key of most rows is many ranges, none of which is one task's alone.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(parts, F.asc(key), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each range of a key
    local = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)))
    return local.join(small(cut_lineage(sizes)), [key, "_part"]).withColumn("rank", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def prune_quota(memories: DataFrame, quotas: DataFrame, now: Column, default_limit: int = 100) -> DataFrame:
    """Adds prune_score and pruned: what an owner holds beyond the limit, lowest score first; limit -1 prunes nothing.

    Counts of an owner's scores by cells tell which cell the limit falls into. Cells above are kept, those below pruned, and
    only the rows of that cell are ranked.
    """
    score = _importance("importance") * 0.4 + _access("accessed_count") * 0.3 + _recency("ts", now) * 0.3
    m = memories.join(small(quotas.select("owner", "memory_limit")), "owner", "left")
    m = m.withColumns({"prune_score": score, "memory_limit": F.coalesce("memory_limit", F.lit(default_limit))})
    m = m.withColumn("_cell", F.floor(F.col("prune_score") * SCORE_CELLS).cast("int"))
    down = Window.partitionBy("owner").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = m.where("memory_limit >= 0").groupBy("owner", "memory_limit", "_cell").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_above", F.coalesce(F.sum("_n").over(down), F.lit(0))).where(F.col("_above") + F.col("_n") > F.col("memory_limit"))
    cut = cut_lineage(cells.groupBy("owner").agg(F.max("_cell").alias("_cut"), F.min("_above").alias("_above")))
    j = m.join(few(cut), "owner", "left")
    sure = j.where("_cut IS NULL OR _cell <> _cut").withColumn("pruned", F.coalesce(F.col("_cell") < F.col("_cut"), F.lit(False)))
    near = rank_within(j.where("_cell = _cut"), "owner", [F.desc("prune_score"), F.asc("memory_id")])
    near = near.withColumn("pruned", F.col("rank") + F.col("_above") > F.col("memory_limit")).drop("rank")
    return sure.unionByName(near).drop("memory_limit", "_cell", "_cut", "_above")


def recall(hits: DataFrame, now: Column, k: int = 5, least: float = 0.7) -> DataFrame:
    """Hits (query_id, memory_id, similarity, importance, ts, accessed_count): of the best max(4k, 20) per query with
    enough similarity, the k of greatest 0.5 importance + 0.3 recency + 0.2 access."""
    w1 = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "memory_id")
    near = hits.where(F.col("similarity") >= least).withColumn("_n", F.row_number().over(w1)).where(F.col("_n") <= max(4 * k, 20)).drop("_n")
    score = _importance("importance") * 0.5 + _recency("ts", now) * 0.3 + _access("accessed_count") * 0.2
    w2 = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return near.withColumn("score", score).withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def renumber(clauses: DataFrame, category_order: DataFrame) -> DataFrame:
    """Adds number 'category.seq': categories in the given order (others last), clauses in theirs."""
    c = clauses.join(category_order, "category", "left")
    order = F.coalesce("position", F.lit(9999))
    c = c.withColumn("_o", order)
    groups = Window.partitionBy("doc_id").orderBy("_o", "category")
    inside = Window.partitionBy("doc_id", "category").orderBy("clause_no")
    number = F.concat_ws(".", F.dense_rank().over(groups).cast("string"), F.row_number().over(inside).cast("string"))
    return c.withColumn("number", number).drop("_o", "position")
