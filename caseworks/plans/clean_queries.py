"""Queries of the per-row expressions: typing, cleaning, masking, labels, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.functions import clean, signals
from caseworks.plans.registry import query, table


@query(
    "p1_type_by_name",
    """SELECT o_orderkey::VARCHAR AS order_key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS order_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total_price, o_orderstatus AS status FROM orders""",
)
def p1(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("total_price"),
        F.col("o_orderstatus").alias("status"),
    )
    return clean.type_by_name(o, ["date"], ["price", "amount"], ["key", "code"])


@query("p2_parse_date_multi", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::DATE END AS day FROM orders")
def p2(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    return o.select("o_orderkey", clean.parse_date_multi(raw).alias("day"))


@query("p3_epoch_to_ts", "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN date_trunc('second', ts) END AS ts FROM events")
def p3(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 5
    s = F.unix_timestamp("ts")
    return e.select("event_id", clean.epoch_to_ts(F.when(k == 0, s).when(k == 1, s * 1000).when(k == 2, s * 1000000).when(k == 3, s).otherwise(0)).alias("ts"))


@query("p4_clean_rows", "SELECT p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand FROM part WHERE p_partkey % 10 <> 0")
def p4(spark, d):
    p, gone = table(spark, d, "part"), F.col("p_partkey") % 10 == 0
    return clean.clean_rows(p.select(F.when(gone, " \t").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name"), F.when(gone | (F.col("p_partkey") % 3 == 0), "").otherwise(F.col("p_brand")).alias("brand")))


@query(
    "p5_flatten_nested",
    """SELECT o_orderkey, o_orderstatus AS status, c_name AS customer, o_custkey::VARCHAR AS ref,
    o_orderpriority || ',' || o_orderstatus AS tags FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def p5(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nested = j.select(
        "o_orderkey",
        F.struct(F.lit("u").alias("uuid"), F.col("o_orderstatus").alias("value")).alias("status"),
        F.struct(F.lit("u").alias("uuid"), F.col("c_name").alias("name")).alias("customer"),
        F.struct(F.col("o_custkey").alias("uuid")).alias("ref"),
        F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.col("o_orderstatus").alias("name"))).alias("tags"),
    )
    return clean.flatten_nested(nested)


@query("p6_extract_code", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN p_brand ELSE regexp_extract(p_brand, '#([0-9]+)', 1) END AS code FROM part")
def p6(spark, d):
    raw = F.when(F.col("p_partkey") % 6 == 0, None).otherwise(F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("P"), "p_brand")))
    code = clean.extract_code(F.when(F.col("p_partkey") % 6 == 0, None).otherwise(raw), r"^PBrand#([0-9]+)")
    return table(spark, d, "part").select("p_partkey", code.alias("code"))


@query(
    "p7_mask_pii",
    """SELECT c_custkey, substr(c_name, 1, 1) || '**' AS customer_name,
    CASE WHEN c_custkey % 2 = 0 THEN '139****' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END AS phone_no,
    CASE WHEN length(c_custkey::VARCHAR) > 3 THEN substr(c_custkey::VARCHAR, 1, 3) || '***@x.org' ELSE '***@x.org' END AS mail FROM customer""",
)
def p7(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    phone = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("139-0000-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("no. "), key))
    return clean.mask_pii(c.select("c_custkey", F.col("c_name").alias("customer_name"), phone.alias("phone_no"), F.concat(key, F.lit("@x.org")).alias("mail")), {"name": "name", "phone": "phone", "mail": "mail"})


@query("p8_jitter")
def p8(spark, d):
    return clean.jitter(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["acctbal", "amount"], 7)


@query(
    "p9_estimate_tokens",
    """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE floor(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.3::DOUBLE
    + (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 2) + 1 END::BIGINT AS tokens FROM documents""",
)
def p9(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.estimate_tokens("text").alias("tokens"))


_RATING = "CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' WHEN 'view' THEN (floor(value)::BIGINT % 6)::VARCHAR WHEN 'click' THEN 'x' END"


@query(
    "p10_rating_sentiment",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 1 WHEN 'view' THEN (floor(value)::BIGINT % 6)::INTEGER ELSE 3 END AS rating FROM events)
    SELECT event_id, rating, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM r""",
)
def p10(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").when(F.col("event_type") == "view", (F.floor("value") % 6).cast("string")).when(F.col("event_type") == "click", "x")
    return e.select("event_id", signals.rating_value(raw).alias("rating"), signals.rating_sentiment(raw).alias("sentiment"))


@query(
    "p11_signal_sentiment",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'view' THEN 'neutral' WHEN value * 200 > 10000 THEN 'negative'
    WHEN event_id % 5 > 2 THEN 'negative' WHEN value / 100 > 0.8 THEN 'positive' ELSE 'unknown' END AS sentiment FROM events""",
)
def p11(spark, d):
    return table(spark, d, "events").select("event_id", signals.signal_sentiment("event_type", F.col("value") * 200, F.col("event_id") % 5, F.col("value") / 100).alias("sentiment"))


@query(
    "p12_root_cause",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'success_pattern' WHEN value > 30 THEN 'resource_limit' WHEN event_id % 3 = 0 THEN 'knowledge_gap'
    WHEN event_id % 3 = 1 THEN 'skill_defect' ELSE 'unknown' END AS cause FROM events""",
)
def p12(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, "Key NOT FOUND").when(k == 1, "missing: an Exception").otherwise(F.lit("timed out"))
    return table(spark, d, "events").select("event_id", signals.root_cause(F.col("event_type") != "error", text, F.col("value") * 10).alias("cause"))


@query(
    "p13_triage",
    """SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 AND lower(text) LIKE '%thon%' THEN 'P0' WHEN conv_id % 4 = 1 THEN 'P1'
    WHEN lower(text) LIKE '%heed%' OR conv_id % 4 = 3 THEN 'P3' ELSE 'P2' END AS level FROM conversations""",
)
def p13(spark, d):
    c, k = table(spark, d, "conversations"), F.col("conv_id") % 4
    mails = c.select("conv_id", "turn", F.col("text").alias("subject"), F.when(k == 0, "OA@corp.example").when(k == 3, "noreply@shop.example").otherwise(F.lit("someone@corp.example")).alias("from_addr"), F.when(k == 1, "Me@corp.example").otherwise(F.lit("all@corp.example")).alias("to_addr"))
    return signals.triage(mails, "me@corp.example", "thon", "oa@|workflow@", "heed", "noreply|no-reply|system|notify").select("conv_id", "turn", "level")


@query(
    "p14_delivery_metrics",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS est, CASE WHEN l_partkey % 5 <> 0 THEN o_orderdate::DATE END AS base,
      CASE WHEN l_partkey % 7 <> 0 THEN (l_shipdate + to_days((l_partkey % 41 - 20)::INTEGER))::DATE END AS act, o_orderstatus AS status
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT *, date_diff('day', base, est) AS d1, date_diff('day', est, act) AS d2 FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, d1::INTEGER AS plan_days, d2::INTEGER AS delivery_days,
      CASE WHEN d1 IS NULL THEN 'missing' WHEN d1 > 0 THEN 'late' WHEN d1 < 0 THEN 'early' ELSE 'same' END AS plan_label,
      CASE WHEN d2 IS NULL THEN 'missing' WHEN d2 > 0 THEN 'late' WHEN d2 < 0 THEN 'early' ELSE 'same' END AS delivery_label,
      CASE WHEN d1 IS NULL OR status = 'P' THEN 'skip' WHEN date_trunc('month', est) = date_trunc('month', base) THEN 'no' ELSE 'yes' END AS plan_cross,
      CASE WHEN d2 IS NULL OR status = 'P' THEN 'skip' WHEN date_trunc('month', est) = date_trunc('month', act) THEN 'no' ELSE 'yes' END AS delivery_cross,
      CASE WHEN d1 IS NULL OR status = 'P' THEN 0.0 WHEN date_trunc('month', est) = date_trunc('month', base) AND abs(d1) < 15 THEN 0.5 ELSE 1.0 END::DOUBLE AS plan_penalty,
      CASE WHEN d2 IS NULL OR status = 'P' THEN 0.0 WHEN date_trunc('month', est) = date_trunc('month', act) AND abs(d2) < 15 THEN 0.5 ELSE 1.0 END::DOUBLE AS delivery_penalty FROM m""",
)
def p14(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = j.select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("est"), F.when(F.col("l_partkey") % 5 != 0, F.to_date("o_orderdate")).alias("base"), F.when(F.col("l_partkey") % 7 != 0, F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 41 - 20).cast("int"))).alias("act"), F.col("o_orderstatus").alias("status"))
    return signals.delivery_metrics(rows, "est", "base", "act", "status", "P").drop("est", "base", "act", "status")


@query(
    "p15_duration_bucket",
    """WITH r AS (SELECT o_orderkey, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-06-30')) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n <= 90 THEN '<=90' WHEN n <= 180 THEN '<=180' WHEN n <= 365 THEN '<=365' ELSE '>365' END AS bucket FROM r""",
)
def p15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", signals.duration_bucket("o_orderdate", F.lit("1998-06-30").cast("date")).alias("bucket"))


@query(
    "p16_clean_text",
    r"""WITH l AS (SELECT doc_id, [x for x in string_split(replace(replace(text, '***', ''), '###', '#'), chr(10)) if length(trim(x)) >= 3] AS s FROM documents),
    m AS (SELECT doc_id, array_to_string([x for x in s if NOT (regexp_matches(trim(x), '^[0-9\s.\-]+$') AND length(trim(x)) <= 10)], chr(10)) AS t FROM l)
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[|]{4,}', ' ', 'g'), '[:]{4,}', ' ', 'g'), '[=]{4,}', ' ', 'g'), '[-]{5,}', ' ', 'g'), '[.]{5,}', ' ', 'g'), '[ \t]+', ' ', 'g')) AS cleaned FROM m""",
)
def p16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(clean.clean_text("text", [("***", ""), ("###", "#")])).alias("cleaned"))


@query("p17_merge_broken_lines")
def p17(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.merge_broken_lines("text", gap=" ").alias("text"))


@query(
    "p18_text_quality",
    r"""WITH a AS (SELECT doc_id, text AS c, regexp_replace(text, '\s', '', 'g') AS s, string_split(text, chr(10)) AS l FROM documents),
    b AS (SELECT doc_id, c, length(s) AS n, length(regexp_replace(s, '[^─│┌┐└┘├┤┬┴┼╔╗╚╝═║■□▪▫●○◆◇★☆@®©™]', '', 'g')) AS g, length(regexp_replace(s, '[\pL\pN\pP\pS\pM]', '', 'g')) AS bad,
      [length(trim(x))::DOUBLE for x in l if trim(x) <> ''] AS z, len([x for x in l if length(trim(x)) < 3]) / len(l) AS short, len([x for x in l if trim(x) = '']) / len(l) AS blank FROM a),
    e AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (n - g - bad) / n * (1 - g / n * 0.5))) END AS char_ratio,
      CASE WHEN c = '' THEN 5 ELSE least(5, floor(((short > 0.4)::INTEGER + (blank > 0.5)::INTEGER) / 2) + 1) END::INTEGER AS noise_level,
      CASE WHEN len(z) < 3 THEN 1.0 ELSE greatest(0.0, 1 - sqrt(greatest(0.0, list_sum([x * x for x in z]) / len(z) - (list_sum(z) / len(z)) ** 2)) / greatest(list_sum(z) / len(z), 1.0)) * 0.6 + 0.4 END AS coherence FROM b),
    f AS (SELECT *, (char_ratio * 100 + (5 - noise_level) * 25 + coherence * 100) / 3 AS quality FROM e)
    SELECT doc_id, round(char_ratio, 6) AS char_ratio, noise_level, round(coherence, 6) AS coherence, round(quality, 4) AS quality,
      CASE WHEN quality >= 90 THEN 'excellent' WHEN quality >= 75 THEN 'good' WHEN quality >= 60 THEN 'fair' ELSE 'poor' END AS quality_name FROM f""",
)
def p18(spark, d):
    q = clean.text_quality(table(spark, d, "documents").select("doc_id", "text"), "text")
    return q.select("doc_id", F.round("char_ratio", 6).alias("char_ratio"), "noise_level", F.round("coherence", 6).alias("coherence"), F.round("quality", 4).alias("quality"), "quality_name")
