"""Streaming operators run over files and are held against their batch twins."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from caseworks.streaming import alerts
from tests.compare import rows

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, df, make, mode="append", parts=1):
    src = str(tmp_path / uuid.uuid4().hex)
    df.orderBy("ts").coalesce(parts).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    name = "q" + uuid.uuid4().hex
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_threshold(spark, tmp_path):
    r = spark.createDataFrame([("slow", "WARN", "click", 20.0, ">"), ("same", "INFO", "view", 3.0, "==")], "name string, level string, metric string, threshold double, op string")
    m = events(spark).select(F.col("event_type").alias("metric"), "ts", "value")
    make = lambda df: alerts.threshold_alerts(df, r)
    assert rows(run(spark, tmp_path, m, make)) == rows(make(m))


def test_windows(spark, tmp_path):
    e = events(spark).select("ts", (F.col("event_type") == "error").alias("is_error"))
    make = lambda df: alerts.error_rate(df, "6 hours", "1 hour")
    got, want = rows(run(spark, tmp_path, e, make, "complete")), rows(make(e))
    assert got == want
    closed = rows(run(spark, tmp_path, e, make))
    assert set(closed) <= set(want)


FAR = "2030-01-01"


def batches(spark, tmp_path, df, by, n=3):
    """A stream of df's rows in n micro-batches by the column `by`, and then of one row of a key of its own, far ahead,
    that moves the watermark past all others."""
    src = tmp_path / uuid.uuid4().hex
    far = df.limit(1).select(*[(F.lit(FAR).cast("timestamp") if t == "timestamp" else F.lit("far") if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes])
    for k, part in enumerate([*[df.where(F.pmod(by, F.lit(n)) == k) for k in range(n)], far]):
        part.coalesce(1).write.parquet(str(src / f"b{k}"))
        for f in (src / f"b{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(src))


def results(spark, tmp_path, stream):
    name = "q" + uuid.uuid4().hex
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(300)
    assert q.exception() is None
    state = [s for p in q.recentProgress for s in p.stateOperators]
    return spark.table(name), state


def conditions(spark):
    return events(spark).select(F.lit("r").alias("rule"), (F.col("user_id") % 3).cast("string").alias("instance"), "ts", (F.col("value") > 5).alias("active"))


@pytest.mark.parametrize("at", ["sample", "deadline"])
def test_held_out_of_order(spark, tmp_path, at):
    """Samples are dealt to three batches by hash, so each batch holds times from the whole span."""
    c = conditions(spark).dropDuplicates(["instance", "ts"])
    got, _ = results(spark, tmp_path, alerts.held_for(batches(spark, tmp_path, c, F.hash("ts")), "3 HOURS", 3 * 3600, "100 days", at))
    want = alerts.held_for(c, "3 HOURS", 3 * 3600, at=at).select("rule", "instance", "since", "held_at")
    assert rows(got.where("rule <> 'far'")) == rows(want) and want.count() > 3


def test_held_deadline_needs_no_further_sample(spark, tmp_path):
    t = lambda x: f"2024-01-01 {x}:00"
    data = [("a", t("00:00"), True), ("a", t("00:01"), True), ("b", t("00:00"), True), ("b", t("00:05"), False), ("c", t("00:00"), True), ("c", t("00:06"), False), ("c", t("00:07"), True), ("d", t("00:09"), True), ("d", t("00:09"), False), ("e", t("00:30"), False)]
    c = spark.createDataFrame(data, "instance string, ts string, active boolean").select(F.lit("r").alias("rule"), "instance", F.col("ts").cast("timestamp").alias("ts"), "active")
    want = [("a", t("00:05")), ("c", t("00:05")), ("c", t("00:12")), ("d", t("00:14"))]
    out = alerts.held_for(c, "5 MINUTES", 300, at="deadline")
    assert sorted((r.instance, str(r.held_at)) for r in out.collect()) == want
    got, _ = results(spark, tmp_path, alerts.held_for(batches(spark, tmp_path, c, F.hash("instance")), "5 MINUTES", 300, "1 hour", "deadline"))
    assert sorted((r.instance, str(r.held_at)) for r in got.where("rule <> 'far'").collect()) == want


def test_held_state_of_idle_keys_goes(spark, tmp_path):
    c = conditions(spark)
    _, state = results(spark, tmp_path, alerts.held_for(batches(spark, tmp_path, c, F.lit(0), 1), "3 HOURS", 3 * 3600, "1 hour", "deadline", idle_seconds=86400))
    assert state[-1].numRowsTotal <= 3  # of the last, far row alone


@pytest.mark.parametrize("forget", [0, 6 * 3600])
def test_suppress_two_streams(spark, tmp_path, forget):
    """Alerts and silences are streams, both out of order; the rows and first_seen are the batch's."""
    a = events(spark).select("event_id", F.col("event_type").alias("name"), "ts", "value")
    hours = F.make_interval(hours=F.lit(2))
    s = a.where("event_id % 40 = 7").select("name", F.col("ts").alias("from_ts"), (F.col("ts") + hours).alias("until_ts"))
    stream = alerts.suppress(batches(spark, tmp_path, a, F.hash("event_id")), batches(spark, tmp_path, s, F.hash("from_ts")), "100 days", forget)
    got, state = results(spark, tmp_path, stream)
    want = alerts.suppress(a, s, forget_seconds=forget)
    assert rows(got.where("name <> 'far'")) == rows(want) and 0 < want.count() < a.count()
    assert state[-1].numRowsTotal < 40  # alerts and silences are gone, a first time for each name stays


def test_suppress_static_silences(spark, tmp_path):
    a = events(spark).select("event_id", F.col("event_type").alias("name"), "ts")
    s = a.where("event_id % 40 = 7").select("name", F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("until_ts"))
    got, _ = results(spark, tmp_path, alerts.suppress(batches(spark, tmp_path, a, F.hash("event_id")), s, "100 days"))
    assert rows(got.where("name <> 'far'")) == rows(alerts.suppress(a, s))


def test_dedup(spark, tmp_path):
    e = events(spark).select((F.col("event_id") % 900).alias("request_id"), "ts", "value")
    make = lambda df: alerts.dedup_requests(df, watermark="60 days")
    got = run(spark, tmp_path, e, make)
    assert got.count() == e.select("request_id").distinct().count()


def test_running_stats(spark, tmp_path):
    r = events(spark).select(F.col("user_id").alias("skill"), "ts", (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"))
    assert rows(run(spark, tmp_path, r, alerts.running_stats, "complete")) == rows(alerts.running_stats(r))


def test_sessions(spark, tmp_path):
    kind = F.when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "purchase", "done").otherwise("other")
    e = events(spark).select(F.col("user_id").alias("session_id"), "ts", kind.alias("kind"), (F.col("value") * 100).alias("response_ms"))
    make = lambda df: alerts.session_signals(df, "8 hours")
    assert set(rows(run(spark, tmp_path, e, make))) <= set(rows(make(e)))
