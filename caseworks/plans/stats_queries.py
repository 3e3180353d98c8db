"""Queries of aggregations and windows on events (as usage, feedback, runs, memories), orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.operators import enrich, stats, trends
from caseworks.plans.registry import query, table
from caseworks.plans.relational_queries import FB_SQL, MEM_SQL, NOW, USAGE_SQL, feedback, memories, prices, usage


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "a1_usage_stats",
    f"""WITH {USAGE_SQL}, s AS (SELECT scenario, model, ts::DATE::VARCHAR AS day, pt + ct AS tokens, ic + oc AS cost FROM c),
    g AS (SELECT 'all' AS dimension, '' AS member, * FROM s UNION ALL SELECT 'scenario', scenario, * FROM s UNION ALL SELECT 'model', model, * FROM s UNION ALL SELECT 'day', day, * FROM s)
    SELECT dimension, member, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost) / 1e6, 4)::DOUBLE AS cost, round(sum(tokens) / count(*), 4) AS mean_tokens, round(round(sum(cost) / 1e6, 4) / count(*), 6) AS mean_cost FROM g GROUP BY 1, 2""",
)
def a1(spark, d):
    u = enrich.price_usage(usage(spark, d), prices(spark)).withColumn("day", F.to_date("ts").cast("string"))
    return stats.usage_stats(u, ["scenario", "model", "day"])


@query(
    "a2_check_budget",
    f"""WITH {USAGE_SQL}, s AS (SELECT scenario, sum(ic + oc) / 1e6 AS cost FROM c GROUP BY 1), b(scenario, budget) AS (VALUES ('click', 1.5::DOUBLE), ('view', 1000.0))
    SELECT scenario, round(cost, 6)::DOUBLE AS cost, budget, coalesce(cost > budget, FALSE) AS over FROM s LEFT JOIN b USING (scenario)""",
)
def a2(spark, d):
    u = enrich.price_usage(usage(spark, d), prices(spark)).groupBy("scenario").agg(F.round(F.sum("cost").cast("double"), 6).alias("cost"))
    return stats.check_budget(u, spark.createDataFrame([("click", 1.5), ("view", 1000.0)], "scenario string, budget double"), "scenario")


@query(
    "a3_estimate_cost",
    """WITH t AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE floor(length(text) / 2) + 1 END::BIGINT AS n FROM documents)
    SELECT doc_id, n AS prompt_tokens, floor(n * 0.5)::BIGINT AS completion_tokens, (n * 10 + floor(n * 0.5)::BIGINT * 30) / 1e6 AS cost FROM t""",
)
def a3(spark, d):
    return stats.estimate_cost(table(spark, d, "documents"), "text", "m2", prices(spark)).select("doc_id", "prompt_tokens", "completion_tokens", F.col("cost").cast("double").alias("cost"))


@query("a4_cluster_counts", f"WITH {FB_SQL}, g AS (SELECT coalesce(category, 'general') AS cluster, count(*) AS n FROM f GROUP BY 1) SELECT cluster, n, floor(n * 100 / (SELECT sum(n) FROM g) + 0.5)::BIGINT AS percent FROM g")
def a4(spark, d):
    return stats.cluster_counts(feedback(spark, d), "category", "general")


@query(
    "a5_sentiment_summary",
    f"""WITH {FB_SQL}, g AS (SELECT count(*) AS n, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'unknown') AS unknown FROM f)
    SELECT *, CASE greatest(positive, negative, neutral, unknown) WHEN positive THEN 'positive' WHEN negative THEN 'negative' WHEN neutral THEN 'neutral' ELSE 'unknown' END AS dominant, (positive - negative) / n AS score FROM g""",
)
def a5(spark, d):
    return stats.sentiment_summary(feedback(spark, d))


@query(
    "a6_category_stats",
    f"""WITH {FB_SQL} SELECT coalesce(category, 'general') AS category, count(*) AS n, round(avg(score) FILTER (type = 'explicit'), 6) AS mean_rating, count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM f GROUP BY 1""",
)
def a6(spark, d):
    return stats.category_stats(feedback(spark, d)).withColumn("mean_rating", F.round("mean_rating", 6))


@query(
    "a7_feedback_patterns",
    f"""WITH {FB_SQL}, c AS (SELECT coalesce(category, 'general') AS member, count(*) FILTER (sentiment = 'negative') AS n, count(*) FILTER (sentiment = 'negative') / count(*) AS v FROM f GROUP BY 1)
    SELECT * FROM (SELECT CASE WHEN v > 0.3 THEN 'severe_category' ELSE 'negative_category' END AS pattern, member, n, round(v, 6) AS value FROM c WHERE n > 0 ORDER BY v DESC, member LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 'busy_hour', hour(ts)::VARCHAR, count(*) AS n, NULL FROM f GROUP BY hour(ts) ORDER BY n DESC, hour(ts) LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 'signal', signal, count(*) AS n, NULL FROM f WHERE type = 'implicit' GROUP BY signal ORDER BY n DESC, signal LIMIT 5)
    UNION ALL SELECT 'mixed_ratings', '', count(*), round(var_pop(score), 6) FROM f WHERE type = 'explicit' HAVING count(*) > 5 AND var_pop(score) > 2""",
)
def a7(spark, d):
    return stats.feedback_patterns(feedback(spark, d)).withColumn("value", F.round("value", 6))


@query(
    "a8_suggest",
    f"""WITH {FB_SQL}, c AS (SELECT coalesce(category, 'general') AS k, count(*) FILTER (sentiment = 'negative') AS n, count(*) FILTER (sentiment = 'negative') / count(*) AS v, avg(score) FILTER (type = 'explicit') AS m FROM f GROUP BY 1),
    s AS (SELECT k AS category, 1 AS priority FROM (SELECT * FROM c WHERE n > 0 ORDER BY v DESC, k LIMIT 3) WHERE v > 0.3 UNION ALL SELECT k, 2 FROM c WHERE m < 3),
    t AS (SELECT CASE min(priority) WHEN 1 THEN 'Fix complaints in ' ELSE 'Fix  complaints in ' END || category AS title, category, min(priority)::INTEGER AS priority FROM s GROUP BY category),
    x AS (SELECT (count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative')) < 0 AS bad, count(*) FILTER (type = 'explicit') > 5 AND var_pop(score) FILTER (type = 'explicit') > 2 AS mixed FROM f)
    SELECT * FROM (SELECT * FROM t UNION ALL SELECT 'Improve overall sentiment', 'general', 1 FROM x WHERE bad UNION ALL SELECT 'Look into mixed ratings', 'general', 3 FROM x WHERE mixed) ORDER BY priority, category, title LIMIT 5""",
)
def a8(spark, d):
    f = feedback(spark, d)
    return stats.suggest(stats.feedback_patterns(f), stats.sentiment_summary(f), stats.category_stats(f))


@query(
    "a9_project_status",
    """WITH g AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'F') AS n_F FROM orders GROUP BY 1)
    SELECT o_custkey, total, n_O, n_F, total - n_O - n_F AS rest, CASE WHEN n_F >= total THEN 'closed' WHEN n_F + n_O >= total THEN 'acceptable' WHEN n_F + n_O > 0 THEN 'partly acceptable' ELSE 'not acceptable' END AS project_state,
    CASE WHEN n_F > 0 THEN 'accepted' ELSE 'due' END AS delivery_state, CASE WHEN n_F >= total THEN 'all' WHEN n_F > 0 THEN 'part' ELSE 'normal' END AS acceptance_state FROM g""",
)
def a9(spark, d):
    return stats.project_status(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["O", "F"], [], ["F"], ["O"])


@query(
    "a10_item_stats",
    """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN '(all)' ELSE o_orderpriority END AS project, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS in_progress,
    count(*) FILTER (o_orderstatus = 'O') AS pending, sum(o_custkey % 4)::BIGINT AS subtasks, round(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*), 2) AS completion FROM orders GROUP BY ROLLUP (o_orderpriority)""",
)
def a10(spark, d):
    i = table(spark, d, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 4).alias("subtasks"))
    return stats.item_stats(i, "project", ["F"], ["P"])


@query(
    "a11_triage_counts",
    """SELECT CASE WHEN conv_id % 4 = 1 THEN 'P1' WHEN lower(text) LIKE '%heed%' THEN 'P3' ELSE 'P2' END AS level, count(*) AS n FROM conversations GROUP BY 1""",
)
def a11(spark, d):
    from caseworks.functions.signals import triage

    c = table(spark, d, "conversations").select(F.col("text").alias("subject"), F.lit("a@x.example").alias("from_addr"), F.when(F.col("conv_id") % 4 == 1, "me@x.example").otherwise(F.lit("b@x.example")).alias("to_addr"))
    return stats.counts_by(triage(c, "me@x.example", "zzz", "oa@", "heed", "noreply"), "level")


@query("a14_run_stats", "SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS successes, round(avg(value), 6) AS mean_seconds, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events GROUP BY 1")
def a14(spark, d):
    r = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"))
    return stats.run_stats(r, "user_id").withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(
    "a14_cause_distribution",
    """WITH r AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN 'success_pattern' WHEN value * 10 > 300 THEN 'resource_limit' WHEN event_id % 3 = 0 THEN 'knowledge_gap' WHEN event_id % 3 = 1 THEN 'skill_defect' ELSE 'unknown' END AS root_cause FROM events)
    SELECT user_id, root_cause, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM r GROUP BY 1, 2""",
)
def a14_causes(spark, d):
    e = F.when(F.col("event_id") % 3 == 0, "Key not found").when(F.col("event_id") % 3 == 1, "some error").otherwise("?")
    r = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("success"), e.alias("error"), (F.col("value") * 10).alias("seconds"))
    return stats.cause_distribution(r, "user_id").withColumn("share", F.round("share", 6))


@query(
    "a15_triggers",
    """WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'error')) AS k FROM events GROUP BY 1)
    SELECT 'mend' AS kind, user_id::VARCHAR AS id FROM g WHERE n >= 3 AND k / n < 0.5 UNION ALL SELECT 'raise', user_id::VARCHAR FROM g WHERE n >= 5 AND (n - k) / n > 0.8
    UNION ALL SELECT 'promote', user_id::VARCHAR FROM g WHERE n >= 10 AND user_id % 2 = 1""",
)
def a15(spark, d):
    e = table(spark, d, "events")
    hit = F.col("event_type").isin("purchase", "error")
    mk = lambda s: stats.run_stats(e.select(F.col("user_id").alias("id"), s.alias("success"), F.col("value").alias("seconds")), "id")
    k = e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("uses")).withColumn("core", F.col("id") % 2 == 0)
    return stats.triggers(mk(hit), mk(~hit), k)


@query(
    "a16_graph_counts",
    """WITH t(kind, type) AS (VALUES ('entity', 'F'), ('entity', 'O'), ('entity', 'X'), ('relation', 'A'), ('relation', 'N'), ('relation', 'Z'))
    SELECT kind, type, CASE kind WHEN 'entity' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = type) ELSE (SELECT count(*) FROM lineitem WHERE l_returnflag = type) END AS n FROM t""",
)
def a16(spark, d):
    t = spark.createDataFrame([("entity", "F"), ("entity", "O"), ("entity", "X"), ("relation", "A"), ("relation", "N"), ("relation", "Z")], "kind string, type string")
    return stats.graph_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("type")), table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rel")), t)


@query("a17_memory_stats", f"WITH {MEM_SQL} SELECT owner, count(*) AS n, count(DISTINCT memory_type) AS n_types, round(avg(importance), 6) AS mean_importance, sum(accessed_count)::BIGINT AS accesses, arg_min(memory_id, (-accessed_count, memory_id)) AS most_accessed FROM m GROUP BY 1")
def a17(spark, d):
    return stats.memory_stats(memories(spark, d)).withColumn("mean_importance", F.round("mean_importance", 6))


@query(
    "a18_store_totals",
    """SELECT 'documents' AS name, count(*) AS rows, sum(octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)))::BIGINT AS bytes FROM documents
    UNION ALL SELECT 'events', count(*), sum(octet_length(encode(event_type)) + octet_length(encode(props)))::BIGINT FROM events""",
)
def a18(spark, d):
    return stats.store_totals(documents=table(spark, d, "documents"), events=table(spark, d, "events"))


@query(
    "a19_merge_report",
    """WITH w AS (SELECT source, len(string_split(text, ' ')) AS words, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 2 = 0 THEN ['even', lang] ELSE [lang] END AS c FROM documents)
    SELECT 'all' AS dimension, '' AS member, count(*) AS n, sum(words)::BIGINT AS words FROM w UNION ALL SELECT 'source', source, count(*), sum(words)::BIGINT FROM w GROUP BY source
    UNION ALL SELECT 'category', k, count(*), sum(words)::BIGINT FROM (SELECT unnest(c) AS k, words FROM w) GROUP BY k""",
)
def a19(spark, d):
    k = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 2 == 0, F.array(F.lit("even"), "lang")).otherwise(F.array("lang"))
    return stats.merge_report(table(spark, d, "documents").select("source", F.size(F.split("text", " ")).alias("words"), k.alias("categories")))


@query(
    "a20_telemetry",
    """WITH s AS (SELECT event_type AS skill, value AS latency, user_id, event_id % 10 <> 0 AS success, 'e' || (user_id % 3) AS error FROM events),
    t AS (SELECT skill, arg_max(error, (n, error)) AS top_error FROM (SELECT skill, error, count(*) AS n FROM s WHERE NOT success GROUP BY 1, 2) GROUP BY 1)
    SELECT skill, count(*) AS calls, count(*) FILTER (success) AS successes, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, count(DISTINCT user_id) AS users,
      any_value(top_error) AS top_error, count(*) FILTER (NOT success) AS failures, count(*) FILTER (success) / count(*) < 0.9 AS low_success, quantile_cont(latency, 0.95) > 120 AS slow, count(*) FILTER (NOT success) / count(*) > 0.1 AS failing FROM s LEFT JOIN t USING (skill) GROUP BY 1""",
)
def a20(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("skill"), F.col("value").alias("latency"), "user_id", (F.col("event_id") % 10 != 0).alias("success"), F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string")).alias("error"))
    t = stats.telemetry(s, "skill", exact=True)
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@query(
    "a20_sketches",
    "SELECT event_type AS skill, count(*) AS calls, count(*) FILTER (event_id % 10 <> 0) AS successes, round(avg(value), 6) AS mean, TRUE AS p50_near, TRUE AS p95_near, TRUE AS p99_near, TRUE AS users_near FROM events GROUP BY 1",
)
def a20_sketches(spark, d):
    """Sketches per skill and day, rolled up per skill; the ranks of their quantiles in all spans, and their numbers of users,
    lie within the stated bounds."""
    s = table(spark, d, "events").select(F.col("event_type").alias("skill"), "ts", F.col("value").alias("latency"), "user_id", (F.col("event_id") % 10 != 0).alias("success"))
    r = stats.roll_up(stats.telemetry_sketches(s, "skill"), ["skill"])
    near = lambda p, at: ((F.count_if(F.col("latency") < F.col(p)) / F.count("*") <= at + stats.RANK_ERROR) & (F.count_if(F.col("latency") <= F.col(p)) / F.count("*") >= at - stats.RANK_ERROR)).alias(f"{p}_near")
    users = (F.abs(F.count_distinct("user_id") - F.first("users")) <= 0.05 * F.count_distinct("user_id")).alias("users_near")
    return s.join(r, "skill").groupBy("skill").agg(F.first("calls").alias("calls"), F.first("successes").alias("successes"), F.round(F.first("mean"), 6).alias("mean"), near("p50", 0.5), near("p95", 0.95), near("p99", 0.99), users)


@query(
    "a21_import_report",
    """SELECT 'orders' AS file, (SELECT count(*) FROM orders) AS rows, 'o_comment' AS missing, TRUE AS mismatch, (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS nulls
    UNION ALL SELECT 'region', (SELECT count(*) FROM region), '', FALSE, 0""",
)
def a21(spark, d):
    o = table(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return stats.import_report({"orders": o, "region": table(spark, d, "region")}, {"orders": ["o_totalprice", "o_comment", "o_orderkey"], "region": ["r_name"]}, {"orders": 7})


@query("w1_first_flag", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0 WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 1 ELSE 0 END::INTEGER AS is_first FROM orders")
def w1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("project"))
    return trends.first_flag(o, "project", "o_orderkey").select("o_orderkey", "is_first")


@query(
    "w2_kpi_growth",
    """WITH k AS (SELECT o_orderstatus AS kpi, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS v FROM orders GROUP BY 1, 2)
    SELECT kpi, month, k.v AS value, CASE WHEN coalesce(p.v, 0) = 0 THEN 0.0 ELSE round((k.v - p.v) / p.v * 100, 1) END AS mom, CASE WHEN coalesce(y.v, 0) = 0 THEN 0.0 ELSE round((k.v - y.v) / y.v * 100, 1) END AS yoy, round(k.v / 50 * 100, 1) AS completion
    FROM k LEFT JOIN (SELECT kpi, (month + INTERVAL 1 MONTH)::DATE AS month, v FROM k) p USING (kpi, month) LEFT JOIN (SELECT kpi, (month + INTERVAL 12 MONTH)::DATE AS month, v FROM k) y USING (kpi, month)""",
)
def w2(spark, d):
    k = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kpi"), F.to_date(F.trunc("o_orderdate", "month")).alias("month")).agg(F.count("*").alias("value")).withColumn("target", F.lit(50))
    return trends.kpi_growth(k, "kpi", "month", "value", "target").select("kpi", "month", "value", "mom", "yoy", "completion")


TREND_SQL = f"""{FB_SQL}, b AS (SELECT *, greatest(0, date_diff('day', DATE '2024-01-25', ts::DATE)) AS bucket FROM f WHERE ts <= TIMESTAMP '2024-01-31'),
g AS (SELECT bucket, count(*) AS n, avg(score) FILTER (type = 'explicit') AS mean_rating, count(*) FILTER (sentiment = 'positive') / count(*) AS positive FROM b GROUP BY 1),
t AS (SELECT i::INTEGER AS bucket, TIMESTAMP '2024-01-25' + to_days(i::INTEGER) AS start, coalesce(n, 0) AS n, mean_rating, coalesce(positive, 0) AS positive FROM range(7) r(i) LEFT JOIN g ON i = bucket)"""


def _trend(spark, d):
    return trends.trend(feedback(spark, d), now(), "week")


@query("w3_trend", f"WITH {TREND_SQL} SELECT bucket, start, n, round(mean_rating, 6) AS mean_rating, round(positive, 6) AS positive FROM t")
def w3(spark, d):
    return _trend(spark, d).select("bucket", "start", "n", F.round("mean_rating", 6).alias("mean_rating"), F.round("positive", 6).alias("positive"))


@query(
    "w4_trend_direction",
    f"""WITH {TREND_SQL}, x AS (SELECT avg(n) FILTER (bucket < 3) AS a, avg(n) FILTER (bucket >= 3) AS b FROM t)
    SELECT CASE WHEN b > a * 1.1 THEN 'increasing' WHEN b < a * 0.9 THEN 'decreasing' ELSE 'stable' END AS direction, round(least(1.0, abs(b - a) / a), 6) AS confidence FROM x""",
)
def w4(spark, d):
    return trends.trend_direction(_trend(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(
    "w5_rating_decline",
    f"""WITH {TREND_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY bucket DESC) AS k FROM t WHERE mean_rating IS NOT NULL), x AS (SELECT avg(mean_rating) FILTER (k <= 3) AS recent, avg(mean_rating) FILTER (k > 3) AS earlier FROM rk)
    SELECT round(recent, 6) AS recent, round(earlier, 6) AS earlier, coalesce(earlier - recent > 0.5, FALSE) AS declined FROM x""",
)
def w5(spark, d):
    return trends.rating_decline(_trend(spark, d)).withColumns({c: F.round(c, 6) for c in ("recent", "earlier")})


@query(
    "w6_ema",
    """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    e AS (SELECT user_id, k, n, value AS v FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.n, e.v * 0.7::DOUBLE + r.value * 0.3::DOUBLE FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1)
    SELECT user_id, round(v, 6) AS ema, least(n, 100)::INTEGER AS n_history FROM e WHERE k = n""",
)
def w6(spark, d):
    return trends.ema(table(spark, d, "events"), "user_id", "ts", "value").select("user_id", F.round("ema", 6).alias("ema"), F.size("history").alias("n_history"))


_SCORE = "CASE WHEN importance = 0 THEN 0.5 ELSE importance END"
_REC = "greatest(0, 1 - (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400 / 90)"


@query(
    "w7_prune_quota",
    f"""WITH {MEM_SQL}, s AS (SELECT owner, memory_id, round({_SCORE} * 0.4 + least(accessed_count, 100) / 100 * 0.3 + {_REC} * 0.3, 9) AS s FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY s DESC, memory_id) AS k, CASE owner WHEN '1' THEN 10 WHEN '2' THEN -1 ELSE 300 END AS lim FROM s)
    SELECT owner, count(*) AS n, count(*) FILTER (lim >= 0 AND k > lim) AS n_pruned, round(sum(s), 4) AS total FROM r GROUP BY 1""",
)
def w7(spark, d):
    q = spark.createDataFrame([("1", 10), ("2", -1)], "owner string, memory_limit int")
    p = trends.prune_quota(memories(spark, d), q, now(), 300)
    return p.groupBy("owner").agg(F.count("*").alias("n"), F.count_if("pruned").alias("n_pruned"), F.round(F.sum("prune_score"), 4).alias("total"))


@query(
    "w8_recall",
    f"""WITH {MEM_SQL}, h AS (SELECT owner AS query_id, *, (memory_id * 7919 % 1000) / 1000.0::DOUBLE AS similarity FROM m), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS k FROM h WHERE similarity >= 0.7),
    b AS (SELECT *, {_SCORE} * 0.5 + {_REC} * 0.3 + least(accessed_count, 100) / 100 * 0.2 AS score FROM a WHERE k <= 20), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id)::INTEGER AS rank FROM b)
    SELECT query_id, memory_id, round(score, 6) AS score, rank FROM c WHERE rank <= 5""",
)
def w8(spark, d):
    h = memories(spark, d).withColumns({"query_id": F.col("owner"), "similarity": F.col("memory_id") * 7919 % 1000 / 1000})
    return trends.recall(h, now()).select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


@query(
    "w9_renumber",
    """WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS clause_no, o_orderpriority AS category, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 9999 END AS o FROM orders)
    SELECT doc_id, clause_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY o, category) || '.' || row_number() OVER (PARTITION BY doc_id, category ORDER BY clause_no) AS number FROM c""",
)
def w9(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("clause_no"), F.col("o_orderpriority").alias("category"))
    return trends.renumber(c, spark.createDataFrame([("3-MEDIUM", 1), ("1-URGENT", 2)], "category string, position int")).select("doc_id", "clause_no", "number")
