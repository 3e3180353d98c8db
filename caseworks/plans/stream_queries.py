"""Batch twins of the streaming operators on events, and round trips of the readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseworks.plans.registry import query, table
from caseworks.plans.shared import shared_dir
from caseworks.plans.relational_queries import USAGE_SQL, prices, usage
from caseworks.sources import io
from caseworks.streaming import alerts


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "st1_threshold_alerts",
    """SELECT event_id, name, level FROM events, (VALUES ('slow', 'WARN', 'click', 20.0, '>'), ('very slow', 'ERROR', 'click', 40.0, '>='), ('cheap', 'INFO', 'purchase', 2.0, '<')) r(name, level, m, t, op)
    WHERE event_type = m AND CASE op WHEN '>' THEN value > t WHEN '>=' THEN value >= t ELSE value < t END""",
)
def st1(spark, d):
    r = spark.createDataFrame([("slow", "WARN", "click", 20.0, ">"), ("very slow", "ERROR", "click", 40.0, ">="), ("cheap", "INFO", "purchase", 2.0, "<")], "name string, level string, metric string, threshold double, op string")
    return alerts.threshold_alerts(_events(spark, d).select("event_id", F.col("event_type").alias("metric"), "ts", "value"), r).select("event_id", "name", "level")


@query(
    "st2_error_rate",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i::INTEGER) AS start FROM events, range(6) r(i)) SELECT start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate, count(*) FILTER (event_type = 'error') / count(*) > 0.1 AS alert FROM w GROUP BY 1""",
)
def st2(spark, d):
    e = _events(spark, d).select("ts", (F.col("event_type") == "error").alias("is_error"))
    return alerts.error_rate(e, "6 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("rate", 6).alias("rate"), "alert")


@query("st3_p95_latency", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, quantile_cont(value, 0.95) > 30 AS alert FROM events GROUP BY 1")
def st3(spark, d):
    e = _events(spark, d).select("ts", F.col("value").alias("latency"))
    return alerts.p95_latency(e, "1 day", exact=True).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("p95", 6).alias("p95"), "alert")


@query(
    "st4_held_for",
    """WITH c AS (SELECT (user_id % 10)::VARCHAR AS instance, ts, value > 5 AS active, lag(value > 5) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p = active THEN 0 ELSE 1 END) OVER (PARTITION BY instance ORDER BY ts) AS k FROM c),
    a AS (SELECT *, min(ts) OVER (PARTITION BY instance, k) AS since FROM s WHERE active) SELECT instance, since, min(ts) AS held_at FROM a WHERE ts >= since + INTERVAL 3 HOURS GROUP BY 1, 2""",
)
def st4(spark, d):
    c = _events(spark, d).select(F.lit("r").alias("rule"), (F.col("user_id") % 10).cast("string").alias("instance"), "ts", (F.col("value") > 5).alias("active"))
    return alerts.held_for(c, "3 HOURS", 3 * 3600).select("instance", F.col("since").cast("timestamp_ntz").alias("since"), F.col("held_at").cast("timestamp_ntz").alias("held_at"))


@query("st5_suppress", "WITH k AS (SELECT event_id, event_type AS name, ts FROM events WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-07')) SELECT event_id, name, min(ts) OVER (PARTITION BY name) AS first_seen FROM k")
def st5(spark, d):
    s = spark.createDataFrame([("error", "2023-12-01", "2024-01-07")], "name string, f string, u string").select("name", F.col("f").cast("timestamp").alias("from_ts"), F.col("u").cast("timestamp").alias("until_ts"))
    return alerts.suppress(_events(spark, d).select("event_id", F.col("event_type").alias("name"), "ts"), s).select("event_id", "name", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


@query(
    "st6_session_signals",
    """WITH e AS (SELECT user_id, ts, event_type, value, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 8 HOURS THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
    g AS (SELECT user_id, min(ts) AS start, count(*) FILTER (event_type = 'error') AS r, count(*) FILTER (event_type = 'purchase') AS dn, count(*) FILTER (event_type = 'view') AS f, max(value) * 100 AS slow, epoch_us(max(ts)) - epoch_us(min(ts)) AS spent FROM s GROUP BY user_id, k)
    SELECT user_id, start, 'high_retry_rate' AS signal FROM g WHERE r > 3 UNION ALL SELECT user_id, start, 'smooth_completion' FROM g WHERE dn > 0 AND slow < 5000 UNION ALL SELECT user_id, start, 'early_abandonment' FROM g WHERE dn = 0 AND spent < 10000000 UNION ALL SELECT user_id, start, 'high_engagement' FROM g WHERE f > 2""",
)
def st6(spark, d):
    kind = F.when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "view", "follow_up").otherwise(F.lit("other"))
    e = _events(spark, d).select(F.col("user_id").alias("session_id"), "ts", kind.alias("kind"), (F.col("value") * 100).alias("response_ms"))
    return alerts.session_signals(e, "8 hours").select(F.col("session_id").alias("user_id"), F.col("start").cast("timestamp_ntz").alias("start"), "signal")


@query("st7_running_stats", "SELECT user_id AS skill, count(*) AS runs, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg(value), 6) AS mean_seconds, count(*) >= 3 AND avg((event_type <> 'error')::INT) < 0.5 AS mend FROM events GROUP BY 1")
def st7(spark, d):
    r = _events(spark, d).select(F.col("user_id").alias("skill"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"))
    return alerts.running_stats(r).withColumns({c: F.round(c, 6) for c in ("success_rate", "mean_seconds")})


@query("st8_daily_cost", f"WITH {USAGE_SQL} SELECT ts::DATE AS day, scenario, count(*) AS calls, sum(ic + oc)::BIGINT / 1e6 AS cost, coalesce(sum(ic + oc) / 1e6 > CASE scenario WHEN 'click' THEN 0.1 WHEN 'view' THEN 100.0 END, FALSE) AS over FROM c GROUP BY 1, 2")
def st8(spark, d):
    u = usage(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return alerts.daily_cost(u, prices(spark), spark.createDataFrame([("click", 0.1), ("view", 100.0)], "scenario string, budget double"))


@query("st9_dedup_requests", "SELECT event_id % 5000 AS request_id, min(ts) AS ts FROM events GROUP BY 1")
def st9(spark, d):
    e = _events(spark, d).select((F.col("event_id") % 5000).alias("request_id"), "ts", "value")
    return alerts.dedup_requests(e).select("request_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "st10_pair_runs_stream",
    """SELECT a.event_id AS run_id, a.event_type AS task, coalesce(b.event_type, 'timeout') AS status FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 4 MINUTES WHERE a.event_id % 2 = 0""",
)
def st10(spark, d):
    e = _events(spark, d)
    s = e.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("task"), F.col("ts").alias("started_at"))
    f = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("run_id"), F.col("ts").alias("finished_at"), F.col("event_type").alias("status"))
    return alerts.pair_runs_stream(s, f, "4 MINUTES").select("run_id", "task", "status")


@query("st11_late_policy", "SELECT greatest(ts, TIMESTAMP '2024-01-10')::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def st11(spark, d):
    return _events(spark, d).groupBy(F.to_date(alerts.late(F.col("ts"), F.lit("2024-01-10").cast("timestamp"))).alias("day")).agg(F.count("*").alias("n"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query("io1_read_delimited", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey::VARCHAR END AS nation FROM supplier")
def io1(spark, d):
    path = _folder(spark)
    io.write_export(table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 5 == 0, "NA").otherwise(F.col("s_nationkey").cast("string")).alias("nation")), path)
    return io.read_delimited(spark, path)


@query("io2_read_file_set", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def io2(spark, d):
    path = _folder(spark)
    for name in ("customer", "orders"):
        io.write_export(table(spark, d, name), f"{path}/202401-{name}-x.csv")
    got = io.read_file_set(spark, path, "202401", {"customer": "customer", "orders": "orders"})
    return got["customer"].agg(F.count("*").alias("n")).select(F.lit("customer").alias("name"), "n").unionByName(got["orders"].agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n"))


@query("io3_read_oplog", "SELECT event_id AS seq, 'create' AS op, user_id::VARCHAR AS id, event_type AS type, (event_id % 9)::VARCHAR AS k FROM events")
def io3(spark, d):
    path = _folder(spark)
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("create").alias("op"), F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.create_map(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("properties")).alias("entity"))
    io.write_export(e, path, "json")
    return io.read_oplog(spark, path).select("seq", "op", "id", "type", F.col("properties")["k"].alias("k"))


@query("io4_read_documents", "SELECT md5(s_name) AS content_hash, octet_length(encode(s_name))::BIGINT AS size FROM supplier")
def io4(spark, d):
    path = _folder(spark)
    p = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("value"))
    io.write_documents(p, path, "s_suppkey")
    return io.read_documents(spark, path).select("content_hash", "size")


@query(
    "io5_write_export",
    """SELECT doc_id, md5(coalesce(text, '~')) AS csv_text, lang AS csv_lang, md5(coalesce(text, '~')) AS json_text, lang AS json_lang FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN '"' || text || '",' || chr(10) || doc_id END AS text, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang FROM documents)""",
)
def io5(spark, d):
    """Quotes, commas, line breaks and nulls, out and back."""
    text = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit('"'), "text", F.lit('",\n'), F.col("doc_id").cast("string")))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    back = []
    for fmt in ("csv", "json"):
        path = _folder(spark)
        io.write_export(docs, path, fmt)
        read = spark.read.schema(docs.schema)
        got = read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if fmt == "csv" else read.json(path)
        back.append(got.select("doc_id", F.md5(F.coalesce("text", F.lit("~"))).alias(f"{fmt}_text"), F.col("lang").alias(f"{fmt}_lang")))
    return back[0].join(back[1], "doc_id")


@query("io6_write_by_category", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def io6(spark, d):
    path = _folder(spark)
    io.write_by_category(table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), path, "nation")
    return spark.read.parquet(path).groupBy("nation").agg(F.count("*").alias("n"))
