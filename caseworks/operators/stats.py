"""Aggregations: usage, budgets, feedback, projects, runs, memories, graph and import statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseworks.functions import clean, signals
from caseworks.operators import enrich
from caseworks.plans.sizes import small


def usage_stats(usage: DataFrame, dims: list[str]) -> DataFrame:
    """Calls, tokens, cost and averages for each value of each dimension and overall, by grouping sets in one pass.

    One row per (dimension, member); overall is dimension 'all', member ''.
    """
    u = usage.select(*dims, (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), "cost")
    grouped = u.groupingSets([[F.col(x)] for x in dims] + [[]], *[F.col(x) for x in dims]).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), *[F.grouping(x).alias(f"_g{i}") for i, x in enumerate(dims)])
    dimension, member = F.lit("all"), F.lit("")
    for i, x in enumerate(dims):
        dimension = F.when(F.col(f"_g{i}") == 0, x).otherwise(dimension)
        member = F.when(F.col(f"_g{i}") == 0, F.col(x).cast("string")).otherwise(member)
    out = grouped.select(dimension.alias("dimension"), member.alias("member"), "calls", "tokens", F.round("cost", 4).cast("double").alias("cost"))
    return out.withColumns({"mean_tokens": F.round(F.col("tokens") / F.col("calls"), 4), "mean_cost": F.round(F.col("cost") / F.col("calls"), 6)})


def check_budget(stats: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Adds budget and over: cost strictly above the budget of the key; without a budget never over."""
    j = stats.join(small(budgets.select(key, "budget")), key, "left")
    return j.withColumn("over", F.coalesce(F.col("cost") > F.col("budget"), F.lit(False)))


def estimate_cost(texts: DataFrame, text: str, model: str, prices: DataFrame, output_share: float = 0.5) -> DataFrame:
    """Adds the estimated tokens and cost of sending each text to a model and getting a share of its length back."""
    t = texts.withColumns({"model": F.lit(model), "prompt_tokens": clean.estimate_tokens(text)})
    t = t.withColumn("completion_tokens", F.floor(F.col("prompt_tokens") * output_share).cast("long"))
    return enrich.price_usage(t, prices)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(part * 100 / whole + 0.5).cast("long")


def cluster_counts(feedback: DataFrame, dim: str, default: str = "unknown") -> DataFrame:
    """cluster, n and percent of all, most frequent first."""
    g = feedback.groupBy(F.coalesce(F.col(dim).cast("string"), F.lit(default)).alias("cluster")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("cluster", "n", percent(F.col("n"), F.col("total")).alias("percent")).orderBy(F.desc("n"), "cluster")  # total is one row


def sentiment_summary(feedback: DataFrame) -> DataFrame:
    """One row: counts by sentiment, the dominant one, and (positive - negative) / all."""
    kinds = ("positive", "negative", "neutral", "unknown")
    g = feedback.agg(F.count("*").alias("n"), *[F.count_if(F.col("sentiment") == k).alias(k) for k in kinds])
    dominant = F.when(F.col("n") > 0, F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))["k"])
    return g.withColumns({"dominant": dominant, "score": F.when(F.col("n") > 0, (F.col("positive") - F.col("negative")) / F.col("n")).otherwise(0.0)})


def category_stats(feedback: DataFrame) -> DataFrame:
    """Per category (null: general) count, mean explicit rating and counts by sentiment."""
    rated = F.when(F.col("type") == "explicit", signals.rating_value("rating"))
    count = [F.count_if(F.col("sentiment") == k).alias(k) for k in ("positive", "negative", "neutral")]
    return feedback.groupBy(F.coalesce("category", F.lit("general")).alias("category")).agg(F.count("*").alias("n"), F.avg(rated).alias("mean_rating"), *count)


def feedback_patterns(feedback: DataFrame) -> DataFrame:
    """pattern, member, n, value: the three categories with the largest negative share (above 30 % severe), the three
    busiest hours, the five most frequent signals, and the population variance of ratings where more than five are and
    it is above two."""
    f = feedback.withColumn("category", F.coalesce("category", F.lit("general")))
    top = lambda df, n, *by: df.orderBy(*by).limit(n)
    cats = f.groupBy("category").agg(F.count_if(F.col("sentiment") == "negative").alias("n"), (F.count_if(F.col("sentiment") == "negative") / F.count("*")).alias("value"))
    cats = top(cats.where("n > 0"), 3, F.desc("value"), "category").select(F.when(F.col("value") > 0.3, "severe_category").otherwise("negative_category").alias("pattern"), F.col("category").alias("member"), "n", "value")
    hours = top(f.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n")), 3, F.desc("n"), "h").select(F.lit("busy_hour").alias("pattern"), F.col("h").cast("string").alias("member"), "n", F.lit(None).cast("double").alias("value"))
    sigs = top(f.where("type = 'implicit'").groupBy("signal").agg(F.count("*").alias("n")), 5, F.desc("n"), "signal").select(F.lit("signal").alias("pattern"), F.col("signal").alias("member"), "n", F.lit(None).cast("double").alias("value"))
    rating = signals.rating_value("rating").cast("double")
    var = f.where("type = 'explicit'").agg(F.count("*").alias("n"), F.var_pop(rating).alias("value")).where("n > 5 AND value > 2").select(F.lit("mixed_ratings").alias("pattern"), F.lit("").alias("member"), "n", "value")
    return reduce(DataFrame.unionByName, [cats, hours, sigs, var])


def suggest(patterns: DataFrame, sentiment: DataFrame, categories: DataFrame, n: int = 5) -> DataFrame:
    """Suggestions (title, category, priority) from thresholds: severe categories, a negative mood, low-rated categories,
    mixed ratings; one per title without case and spaces, high priority first."""
    row = lambda df, title, category, priority: df.select(title.alias("title"), category.alias("category"), F.lit(priority).alias("priority"))
    parts = [
        row(patterns.where("pattern = 'severe_category'"), F.concat(F.lit("Fix complaints in "), "member"), F.col("member"), 1),
        row(sentiment.where("score < 0"), F.lit("Improve overall sentiment"), F.lit("general"), 1),
        row(categories.where("mean_rating < 3"), F.concat(F.lit("Fix  complaints in "), "category"), F.col("category"), 2),
        row(patterns.where("pattern = 'mixed_ratings'"), F.lit("Look into mixed ratings"), F.lit("general"), 3),
    ]
    from caseworks.operators.retention import dedup_title

    return dedup_title(reduce(DataFrame.unionByName, parts), "title", "priority").orderBy("priority", "category", "title").limit(n)


def project_status(rows: DataFrame, key: str, status: str, values: list[str], delivered: list[str], accepted: list[str], implemented: list[str]) -> DataFrame:
    """Per key the count of each known status, the total, the rest, and three derived states."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    g = rows.groupBy(key).agg(F.count("*").alias("total"), *counts)
    add = lambda names: reduce(lambda a, b: a + b, [F.col(f"n_{v}") for v in names], F.lit(0))
    total, acc, dlv = F.col("total"), add(accepted), add(delivered)
    done = add(implemented) + dlv + acc
    project = F.when(dlv + acc >= total, "closed").when(done >= total, "acceptable").when(done > 0, "partly acceptable").otherwise("not acceptable")
    level = F.when(acc > 0, "accepted").when(dlv > 0, "delivered").otherwise("due")
    acceptance = F.when(acc >= total, "all").when(acc > 0, "part").otherwise("normal")
    return g.withColumns({"rest": total - add(values), "project_state": project, "delivery_state": level, "acceptance_state": acceptance})


def item_stats(items: DataFrame, project: str, done: list[str], running: list[str]) -> DataFrame:
    """Per project and overall ('(all)'): items, done, in progress, pending, subtasks, share done."""
    d, r = F.col("status").isin(done), F.col("status").isin(running)
    g = items.rollup(project).agg(F.count("*").alias("n"), F.count_if(d).alias("done"), F.count_if(r & ~d).alias("in_progress"), F.count_if(~(d | r)).alias("pending"), F.sum(F.coalesce("subtasks", F.lit(0))).alias("subtasks"), F.grouping(project).alias("_g"))
    return g.withColumn(project, F.when(F.col("_g") == 1, "(all)").otherwise(F.col(project))).withColumn("completion", F.round(F.col("done") * 100 / F.col("n"), 2)).drop("_g")


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def split_quality(clauses: DataFrame, low: int = 10, high: int = 25, categories: int = 3, length: int = 50) -> DataFrame:
    """Per document clause count, categories, mean length, risky clauses, and whether all four pass."""
    g = clauses.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.count_distinct("category").alias("n_categories"), F.avg("length").alias("mean_length"), F.count_if(F.col("risk_level") != "none").alias("n_risky"))
    return g.withColumn("passed", F.col("n_clauses").between(low, high) & (F.col("n_categories") >= categories) & (F.col("mean_length") > length) & (F.col("n_risky") >= 1))


def run_stats(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.count_if("success").alias("successes"), F.avg("seconds").alias("mean_seconds")).withColumn("success_rate", F.col("successes") / F.col("runs"))


def cause_distribution(runs: DataFrame, key: str | None = None) -> DataFrame:
    """(key,) root_cause, n, share of the runs (success, error, seconds) by the class of their cause; classes that don't
    occur have no row."""
    keys = [key] if key else []
    g = runs.select(*keys, signals.root_cause("success", "error", "seconds").alias("root_cause")).groupBy(*keys, "root_cause").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)]))))  # of a few rows a key


def triggers(run_stats: DataFrame, ability_stats: DataFrame, knowledge: DataFrame, key: str = "id") -> DataFrame:
    """kind, id: skills to mend (3 runs, rate under 0.5), abilities to raise (5 tasks, rate over 0.8), knowledge to
    promote (10 uses, not core yet)."""
    pick = lambda df, cond, kind: df.where(cond).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    return pick(run_stats, "runs >= 3 AND success_rate < 0.5", "mend").unionByName(pick(ability_stats, "runs >= 5 AND success_rate > 0.8", "raise")).unionByName(pick(knowledge, "uses >= 10 AND NOT core", "promote"))


def graph_counts(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """kind (entity, relation), type, n for every listed type, 0 where none is."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("entity"))
    e = edges.groupBy(F.col("rel").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("relation"))
    return types.join(n.unionByName(e), ["kind", "type"], "left").select("kind", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def memory_stats(memories: DataFrame, owner: str = "owner") -> DataFrame:
    """Per owner: memories, kinds, mean importance, accesses, and the most accessed one (least id of equals)."""
    return memories.groupBy(owner).agg(F.count("*").alias("n"), F.count_distinct("memory_type").alias("n_types"), F.avg("importance").alias("mean_importance"), F.sum("accessed_count").alias("accesses"), F.max_by("memory_id", F.struct("accessed_count", -F.col("memory_id"))).alias("most_accessed"))


def store_totals(**dfs: DataFrame) -> DataFrame:
    """name, rows, bytes of text of each table (columns of type string)."""
    parts = []
    for name, df in dfs.items():
        texts = [c for c, t in df.dtypes if t == "string"]
        size = reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts], F.lit(0)).cast("long")
        parts.append(df.agg(F.count("*").alias("rows"), size.alias("bytes")).select(F.lit(name).alias("name"), "rows", "bytes"))
    return reduce(DataFrame.unionByName, parts)


def merge_report(docs: DataFrame) -> DataFrame:
    """dimension, member, n, words: overall, by source and by category (exploded), in one scan by grouping sets."""
    d = docs.select("source", F.explode_outer("categories").alias("category"), "words", F.monotonically_increasing_id().alias("_id"))
    first = d.withColumn("_first", F.lit(1))
    by_source = docs.select("source", "words").groupingSets([[F.col("source")], []], F.col("source")).agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.grouping("source").alias("_g"))
    a = by_source.select(F.when(F.col("_g") == 1, "all").otherwise("source").alias("dimension"), F.when(F.col("_g") == 1, "").otherwise(F.col("source")).alias("member"), "n", "words")
    b = first.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.sum("words").alias("words")).select(F.lit("category").alias("dimension"), F.col("category").alias("member"), "n", "words")
    return a.unionByName(b)


def telemetry(spans: DataFrame, key: str, exact: bool = False, least_rate: float = 0.9, slowest: float = 120.0, most_errors: float = 0.1) -> DataFrame:
    """Per key calls, successes, failures, mean and p50/p95/p99 latency, users, commonest error, and three flags.

    Percentiles are approximate, of bounded state; exact=True holds each key's distinct latencies in one buffer, for checks.
    """
    rank = (lambda p: F.percentile("latency", F.lit(p))) if exact else (lambda p: F.percentile_approx("latency", F.lit(p), F.lit(10000)))
    g = spans.groupBy(key).agg(F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.avg("latency").alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.count_distinct("user_id").alias("users"))
    errors = spans.where("NOT success").groupBy(key, "error").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("error", F.struct("n", "error")).alias("top_error"))
    out = g.join(errors, key, "left").withColumn("failures", F.col("calls") - F.col("successes"))
    return out.withColumns({"low_success": F.col("successes") / F.col("calls") < least_rate, "slow": F.col("p95") > slowest, "failing": F.col("failures") / F.col("calls") > most_errors})


#: Size of a quantile sketch: ranks are off by RANK_ERROR at most (at 99 % confidence), also after merging.
SKETCH_K = 800
RANK_ERROR = 0.005


def telemetry_sketches(spans: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Per key and day calls, successes, latency_sum, and mergeable sketches of latencies (quantiles) and users (distinct
    numbers): a few kilobytes a row, kept instead of the spans. Null latencies count as calls, but not in the sketch."""
    aggs = [F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.sum("latency").alias("latency_sum"), F.count("latency").alias("timed")]
    sketches = [F.kll_sketch_agg_double(F.col("latency").cast("double"), F.lit(SKETCH_K)).alias("latencies"), F.hll_sketch_agg(F.col("user_id").cast("string")).alias("seen")]
    return spans.groupBy(key, F.to_date(ts).alias("day")).agg(*aggs, *sketches)


def roll_up(sketches: DataFrame, keys: list[str], ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys (none: overall), calls, successes, mean, p50, p95, p99, users of telemetry_sketches' rows, without the spans."""
    aggs = [F.sum("calls").alias("calls"), F.sum("successes").alias("successes"), (F.sum("latency_sum") / F.sum("timed")).alias("mean")]
    g = sketches.groupBy(*keys).agg(*aggs, F.kll_merge_agg_double("latencies").alias("_l"), F.hll_union_agg("seen").alias("_u"))
    at = {f"p{round(r * 100)}": F.when(F.kll_sketch_get_n_double("_l") > 0, F.kll_sketch_get_quantile_double("_l", F.lit(r))) for r in ranks}
    return g.withColumns(at | {"users": F.hll_sketch_estimate("_u")}).drop("_l", "_u")


def import_report(dfs: dict[str, DataFrame], required: dict[str, list[str]], expected_rows: dict[str, int]) -> DataFrame:
    """file, rows, missing columns, row mismatch and nulls in the required columns there are; one pass a table."""
    parts = []
    for name, df in dfs.items():
        need = required.get(name, [])
        have = [c for c in need if c in df.columns]
        nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in have], F.lit(0).cast("long"))
        want = expected_rows.get(name)
        parts.append(df.agg(F.count("*").alias("rows"), nulls.alias("nulls")).select(F.lit(name).alias("file"), "rows", F.lit(",".join(c for c in need if c not in df.columns)).alias("missing"), ((F.col("rows") != want) if want is not None else F.lit(False)).alias("mismatch"), "nulls"))
    return reduce(DataFrame.unionByName, parts)
