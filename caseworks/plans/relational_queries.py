"""Queries of joins, filters, set operations and retention on the star schema, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.operators import enrich, filters, retention
from caseworks.plans.registry import query, table

NOW = "2024-01-31 00:00:00"


def usage(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("scenario"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), F.floor(F.col("value") * 10).cast("long").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), "ts", "user_id")


def prices(spark):
    return spark.createDataFrame([("m0", "0.030", "0.060"), ("m1", "0.001", "0.002"), ("m2", "0.010", "0.030")], "model string, input_price string, output_price string")


USAGE_SQL = """pr(model, pi, po) AS (VALUES ('m0', 30, 60), ('m1', 1, 2), ('m2', 10, 30)),
u AS (SELECT event_id AS request_id, event_type AS scenario, 'm' || (user_id % 4) AS model, floor(value * 10)::BIGINT AS pt, event_id % 100 AS ct, ts, user_id FROM events),
c AS (SELECT u.*, pt * coalesce(pi, 2) AS ic, ct * coalesce(po, 4) AS oc FROM u LEFT JOIN pr USING (model))"""


#: Edges that one task holds to tell them apart, some 100 MB; by its bytes a task would get many more, as keys pack well.
TASK_EDGES = 1_000_000


@query(
    "j1_enrich",
    """SELECT s_suppkey, CASE WHEN n_regionkey <> 2 THEN n_name ELSE 'none' END AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def j1(spark, d):
    dim = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return enrich.enrich(table(spark, d, "supplier"), dim, "s_nationkey", ["nation"], F.lit("none")).select("s_suppkey", "nation")


@query("j2_price_usage", f"WITH {USAGE_SQL} SELECT request_id, ic / 1e6 AS input_cost, oc / 1e6 AS output_cost, (ic + oc) / 1e6 AS cost FROM c")
def j2(spark, d):
    return enrich.price_usage(usage(spark, d), prices(spark)).select("request_id", *[F.col(c).cast("double").alias(c) for c in ("input_cost", "output_cost", "cost")])


@query(
    "j3_collection_stats",
    """WITH k AS (SELECT source AS collection FROM documents GROUP BY 1 UNION SELECT 'empty'),
    x AS (SELECT source AS collection, doc_id, n_chars, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT collection, count(DISTINCT doc_id)::BIGINT AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_chunks, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM k LEFT JOIN x USING (collection) GROUP BY 1""",
)
def j3(spark, d):
    docs = table(spark, d, "documents")
    collections = docs.select(F.col("source").alias("collection")).distinct().unionByName(spark.createDataFrame([("empty",)], "collection string"))
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "line")).drop("line")
    return enrich.collection_stats(collections, docs.select(F.col("source").alias("collection"), "doc_id", F.col("n_chars").alias("size")), chunks)


@query(
    "j4_related",
    """WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)
    SELECT dst AS id, 'in' AS direction, src AS other, p_name AS name FROM e JOIN part ON src = p_partkey
    UNION ALL SELECT src, 'out', dst, p_name FROM e JOIN part ON dst = p_partkey""",
)
def j4(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    edges = edges.repartition(edges.count() // TASK_EDGES + 1, "src", "dst").distinct().withColumn("rel", F.lit("supplied_by"))  # the count reads footers
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    ids = nodes.select("id")
    return enrich.related(nodes, edges, ids, "supplied_by").select("id", "direction", "other", "name")


@query(
    "j5_chunk_context",
    """WITH s AS (SELECT source AS collection, count(*) AS n FROM documents GROUP BY 1)
    SELECT doc_id, (i - 1)::INTEGER AS chunk_no, source AS collection, lang, n AS collection_docs, length(string_split(text, chr(10))[i])::INTEGER AS size
    FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) JOIN s ON source = s.collection""",
)
def j5(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "line")).select("doc_id", "chunk_no", F.length("line").alias("size"))
    collections = docs.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("collection_docs"))
    return enrich.chunk_context(chunks, docs.select("doc_id", F.col("source").alias("collection"), "lang"), collections).select("doc_id", "chunk_no", "collection", "lang", "collection_docs", "size")


@query(
    "j6_tracking_report",
    """WITH t AS (SELECT user_id % 200 AS suggestion_id, event_type AS phase, ts FROM events WHERE event_type IN ('view', 'purchase'))
    SELECT c_custkey AS suggestion_id, c_mktsegment AS category, count(phase)::BIGINT AS n_tracked, max_by(phase, ts) AS last_phase, max(ts) AS last_ts
    FROM customer LEFT JOIN t ON c_custkey = suggestion_id GROUP BY 1, 2""",
)
def j6(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("suggestion_id"), F.col("c_mktsegment").alias("category"))
    t = table(spark, d, "events").where("event_type IN ('view', 'purchase')").select((F.col("user_id") % 200).alias("suggestion_id"), F.col("event_type").alias("phase"), "ts")
    return enrich.tracking_report(s, t)


@query(
    "j7_impact",
    """WITH a AS (SELECT * FROM (VALUES (1, 'click', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-12 00:00:00'), (2, 'view', TIMESTAMP '2024-01-15 12:00:00', TIMESTAMP '2024-01-15 12:00:00'),
      (3, 'click', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-02-20 00:00:00'), (4, 'none', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-20 00:00:00')) t(action_id, category, s, x)),
    m AS (SELECT action_id, a.category, count(*) FILTER (ts >= s - INTERVAL 3 DAYS AND ts < s) AS n_before, avg(value) FILTER (ts >= s - INTERVAL 3 DAYS AND ts < s) AS b,
      count(*) FILTER (ts >= x AND ts < x + INTERVAL 3 DAYS) AS n_after, avg(value) FILTER (ts >= x AND ts < x + INTERVAL 3 DAYS) AS f FROM a LEFT JOIN events ON event_type = a.category GROUP BY 1, 2)
    SELECT action_id, category, n_before, round(b, 6) AS mean_before, n_after, round(f, 6) AS mean_after, round(f - b, 6) AS change FROM m""",
)
def j7(spark, d):
    a = spark.createDataFrame([(1, "click", "2024-01-10 00:00:00", "2024-01-12 00:00:00"), (2, "view", "2024-01-15 12:00:00", "2024-01-15 12:00:00"), (3, "click", "2024-01-20 00:00:00", "2024-02-20 00:00:00"), (4, "none", "2024-01-20 00:00:00", "2024-01-20 00:00:00")], "action_id int, category string, s string, x string")
    a = a.select("action_id", "category", F.col("s").cast("timestamp_ntz").alias("suggested_at"), F.col("x").cast("timestamp_ntz").alias("started_at"))
    f = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    m = enrich.impact(f, a, "3 DAYS", "3 DAYS")
    return m.select("action_id", "category", "n_before", F.round("mean_before", 6).alias("mean_before"), "n_after", F.round("mean_after", 6).alias("mean_after"), F.round("change", 6).alias("change"))


@query(
    "j8_drop_silenced",
    """SELECT event_id, event_type AS name FROM events WHERE NOT (event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07')
    AND NOT (event_type = 'error' AND ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-09') AND NOT (event_type = 'click' AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21')""",
)
def j8(spark, d):
    s = spark.createDataFrame([("error", "2024-01-05", "2024-01-07"), ("error", "2024-01-06", "2024-01-09"), ("click", "2024-01-20", "2024-01-21")], "name string, f string, u string").select("name", F.col("f").cast("timestamp").alias("from_ts"), F.col("u").cast("timestamp").alias("until_ts"))
    a = table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"))
    return enrich.drop_silenced(a, s).select("event_id", "name")


@query(
    "j9_pair_runs",
    """SELECT a.event_id AS run_id, a.event_type AS task, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS seconds, coalesce(b.event_type, 'running') AS status
    FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.event_type <> 'error' WHERE a.event_id % 2 = 0""",
)
def j9(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("task"), F.col("ts").alias("started_at"))
    f = e.where("event_id % 2 = 1 AND event_type <> 'error'").select((F.col("event_id") - 1).alias("run_id"), F.col("ts").alias("finished_at"), F.col("event_type").alias("status"))
    return enrich.pair_runs(s, f).select("run_id", "task", "seconds", "status")


@query(
    "j10_detect_changes",
    """WITH n AS (SELECT source, doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), o AS (SELECT source, doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 5)
    SELECT source, doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS change FROM n FULL JOIN o USING (source, doc_id)""",
)
def j10(spark, d):
    docs = table(spark, d, "documents")
    new = docs.where("doc_id % 10 <> 3").select("source", "doc_id", F.md5("text").alias("h"))
    old = docs.where("doc_id % 10 <> 5").select("source", "doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return enrich.detect_changes(new, old, ["source", "doc_id"], "h")


@query(
    "j11_upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'updated' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN greatest(1, c_custkey % 4) ELSE 1 END::BIGINT AS version FROM customer WHERE FALSE
    UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 >= 1 THEN 'updated' ELSE c_mktsegment END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 >= 1 THEN c_custkey % 4 ELSE 1 END FROM customer""",
)
def j11(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(1).cast("long").alias("version"))
    new = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("updated").alias("c_mktsegment"), (F.col("c_custkey") % 4).alias("version"))
    return enrich.upsert(base, new, ["c_custkey"], "version")


@query("q1_filter_items", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 AND contains(lower('Order ' || o_orderkey), 'er 1')")
def q1(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), (1 - F.col("o_custkey") % 2).alias("subtasks"))
    return filters.filter_items(items, status="O", type="1-URGENT", title="eR 1", has_subtasks=True).select("o_orderkey")


def memories(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("memory_id"), (F.col("user_id") % 20).cast("string").alias("owner"), F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_type").alias("memory_type"), (F.floor("value") % 11 / 10).alias("importance"), (F.col("event_id") % 150).alias("accessed_count"))


MEM_SQL = "m AS (SELECT event_id AS memory_id, (user_id % 20)::VARCHAR AS owner, user_id::VARCHAR AS session_id, ts, event_type AS memory_type, (floor(value)::BIGINT % 11) / 10.0::DOUBLE AS importance, event_id % 150 AS accessed_count FROM events)"


@query("q2_filter_memories", f"WITH {MEM_SQL} SELECT memory_id, importance FROM m WHERE owner = '3' AND memory_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND importance >= 0.5 ORDER BY importance DESC, memory_id LIMIT 25")
def q2(spark, d):
    return filters.filter_memories(memories(spark, d), owner="3", type="click", since=F.lit("2024-01-10").cast("timestamp_ntz"), min_importance=0.5, order="importance", limit=25).select("memory_id", "importance")


def feedback(spark, d):
    """Events as feedback: explicit ratings and implicit signals."""
    from caseworks.functions import signals

    e = table(spark, d, "events")
    explicit = F.col("event_type").isin("purchase", "error", "view")
    raw = F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").when(F.col("event_type") == "view", (F.floor("value") % 6).cast("string"))
    f = e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(explicit, "explicit").otherwise("implicit").alias("type"), F.col("user_id").cast("string").alias("session_id"), raw.alias("rating"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("cat"), (F.col("event_id") % 4).cast("string"))).alias("category"), F.col("event_type").alias("signal"), "value")
    inferred = signals.signal_sentiment("signal", F.lit(None).cast("double"), F.col("id") % 4, F.lit(None).cast("double"))
    return f.withColumn("sentiment", F.when(F.col("type") == "explicit", signals.rating_sentiment("rating")).otherwise(inferred))


FB_SQL = """r AS (SELECT event_id AS id, ts, CASE WHEN event_type IN ('purchase', 'error', 'view') THEN 'explicit' ELSE 'implicit' END AS type, user_id::VARCHAR AS session_id,
  CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' WHEN 'view' THEN (floor(value)::BIGINT % 6)::VARCHAR END AS rating,
  CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 1 WHEN 'view' THEN floor(value)::BIGINT % 6 ELSE 3 END AS score,
  CASE WHEN event_id % 4 <> 0 THEN 'cat' || (event_id % 4) END AS category, event_type AS signal, value FROM events),
f AS (SELECT *, CASE WHEN type = 'explicit' THEN CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative' ELSE 'neutral' END WHEN id % 4 > 2 THEN 'negative' ELSE 'unknown' END AS sentiment FROM r)"""


@query("q3_filter_feedback", f"WITH {FB_SQL} SELECT id, rating, sentiment FROM f WHERE type = 'explicit' AND category = 'cat2' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, id DESC LIMIT 40")
def q3(spark, d):
    return filters.filter_feedback(feedback(spark, d), "explicit", "cat2", F.lit("2024-01-05").cast("timestamp_ntz"), 40).select("id", "rating", "sentiment")


@query("q4_find_entities", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_custkey % 3 = 1 ORDER BY o_orderdate DESC, id LIMIT 30 OFFSET 10")
def q4(spark, d):
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("type"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("properties"), F.array(F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string"))).alias("tags"), F.col("o_orderdate").alias("ts"))
    return filters.find_entities(n, "order", {"status": "F", "priority": "2-HIGH"}, "t1", 30, 10).select("id")


@query("q5_latest_logs", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 240 HOURS AND ts <= TIMESTAMP '2024-01-31') WHERE n <= 3")
def q5(spark, d):
    e = filters.recent(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), F.lit(NOW).cast("timestamp_ntz"), 240)
    return filters.latest_logs(e, "user_id", 3, tie="event_id").select("user_id", "event_id", "event_type")


@query("s1_merge_sources", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, 'customer' AS merged_from, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier', NULL FROM supplier")
def s1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return retention.merge_sources(customer=c, supplier=s)


@query("s2_name_diff", "SELECT DISTINCT p_name AS name, 'missing' AS side FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 2) UNION ALL SELECT DISTINCT p_type, 'extra' FROM part WHERE p_type NOT IN (SELECT p_name FROM part)")
def s2(spark, d):
    p = table(spark, d, "part")
    return retention.name_diff(p.select(F.col("p_name").alias("name")), p.where("p_size < 2").select(F.col("p_name").alias("name")).unionByName(p.select(F.col("p_type").alias("name"))))


@query(
    "s3_cell_diff",
    """WITH a AS (SELECT s_suppkey, s_name, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_suppkey % 10 <> 1), b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name || '*' ELSE s_name END AS s_name, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_suppkey % 10 <> 2),
    x AS (SELECT s_suppkey, 's_name' AS "column", s_name AS v FROM a UNION ALL SELECT s_suppkey, 'nation', nation FROM a), y AS (SELECT s_suppkey, 's_name' AS "column", s_name AS v FROM b UNION ALL SELECT s_suppkey, 'nation', nation FROM b)
    SELECT s_suppkey, "column", x.v AS left_value, y.v AS right_value FROM x FULL JOIN y USING (s_suppkey, "column") WHERE x.v IS DISTINCT FROM y.v""",
)
def s3(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    b = s.where("s_suppkey % 10 <> 2").withColumn("s_name", F.when(F.col("s_suppkey") % 4 == 0, F.concat("s_name", F.lit("*"))).otherwise(F.col("s_name")))
    return retention.cell_diff(s.where("s_suppkey % 10 <> 1"), b, ["s_suppkey"])


@query("s4_dedup_title", "SELECT p_name AS title, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def s4(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat(F.lit(" "), "p_name"))).otherwise(F.col("p_name")).alias("title"))
    return retention.dedup_title(p, "title", "p_partkey").select(F.lower(F.trim("title")).alias("title"), "p_partkey")


def _aged(spark, d):
    m = memories(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return m.withColumns({"tier": F.when(F.col("memory_id") % 3 == 0, "free").otherwise(F.lit("paid")), "expires_at": F.when(F.col("memory_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 9 DAYS"))})


@query(
    "s5_expire",
    f"""WITH {MEM_SQL} SELECT owner, memory_type, count(*)::BIGINT AS n_removed FROM m WHERE (memory_id % 5 = 0 AND ts + INTERVAL 9 DAYS <= TIMESTAMP '2024-01-31') OR (memory_id % 3 = 0 AND ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS) GROUP BY 1, 2""",
)
def s5(spark, d):
    _, gone = retention.expire(_aged(spark, d), F.lit(NOW).cast("timestamp_ntz"), 14)
    return gone.groupBy("owner", "memory_type").agg(F.count("*").alias("n_removed"))


@query(
    "s6_fold_access",
    """WITH l AS (SELECT user_id AS c, count(*) AS n, max(ts) AS t FROM events GROUP BY 1) SELECT c_custkey AS memory_id, (c_custkey % 5 + coalesce(n, 0))::BIGINT AS accessed_count, greatest(TIMESTAMP '2024-01-20', t) AS last_accessed FROM customer LEFT JOIN l ON c = c_custkey""",
)
def s6(spark, d):
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), (F.col("c_custkey") % 5).alias("accessed_count"), F.lit("2024-01-20").cast("timestamp_ntz").alias("last_accessed"))
    return retention.fold_access(m, table(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("ts").cast("timestamp_ntz").alias("ts")))
