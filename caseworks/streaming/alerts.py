"""Alerts and running statistics over event streams. Every function takes a streaming or a batch DataFrame alike; what
needs event time takes a watermark, which bounds its state and drops later rows (a batch run keeps them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseworks.operators import enrich
from caseworks.plans.sizes import small
from caseworks.streaming import stateful


def _marked(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


def threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metric, ts, value, name, level, message for every rule (name, level, metric, threshold, op) that a value meets;
    op is one of > >= < <= ==. A stream-static join with the rules."""
    r = rules.select(F.col("metric").alias("_m"), "name", "level", "threshold", "op")
    j = metrics.join(small(r), F.col("metric") == F.col("_m"))
    v, t = F.col("value"), F.col("threshold")
    met = F.when(F.col("op") == ">", v > t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "<", v < t).when(F.col("op") == "<=", v <= t).when(F.col("op") == "==", v == t).otherwise(False)
    message = F.concat_ws(" ", "metric", F.round("value", 4).cast("string"), "op", "threshold")
    return j.where(met).select(*metrics.columns, "name", "level", message.alias("message"))


def error_rate(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", limit: float = 0.1, watermark: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Per sliding window (and keys) the number of events, the share of errors, and whether it is above the limit."""
    g = _marked(events, "ts", watermark).groupBy(F.window("ts", window, slide), *keys).agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", (F.col("errors") / F.col("n")).alias("rate"), (F.col("errors") / F.col("n") > limit).alias("alert"))


def p95_latency(events: DataFrame, window: str = "5 minutes", limit: float = 30.0, watermark: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Per window the 95th percentile of latency and whether it is above the limit; exact only for batch checks."""
    p = F.percentile("latency", F.lit(0.95)) if exact else F.percentile_approx("latency", F.lit(0.95), F.lit(10000))
    g = _marked(events, "ts", watermark).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), p.alias("p95"))
    return g.select(F.col("window.start").alias("start"), "n", "p95", (F.col("p95") > limit).alias("alert"))


def held_for(conditions: DataFrame, duration: str, seconds: float, watermark: str = "10 minutes", at: str = "sample", idle_seconds: float = 0) -> DataFrame:
    """rule, instance, since, held_at: each time a condition (rule, instance, ts, active) has held for the duration, once
    per stretch of active samples.

    at 'sample': at the first sample that shows it. At 'deadline': as soon as the duration is over, without a further
    sample, if no sample up to then has ended the stretch (a batch knows as far as the rule's last sample of any
    instance, a stream as far as its watermark).
    Batch: stretches by gaps and islands. Stream: samples wait for the watermark and are worked off in order of time, so
    rows may arrive out of order; deadlines are timers. idle_seconds (0: none): a stream forgets a stretch that has had
    no sample for so long. Of equal times an inactive sample comes first.
    """
    if conditions.isStreaming:
        return stateful.held_stream(conditions, seconds, watermark, at, idle_seconds)
    w = Window.partitionBy("rule", "instance").orderBy("ts", "active")
    c = conditions.withColumn("_new", F.when(F.lag("active").over(w) == F.col("active"), 0).otherwise(1))
    c = c.withColumn("_s", F.sum("_new").over(w))
    due = F.col("since") + F.expr(f"INTERVAL {duration}")
    if at == "sample":
        c = c.where("active").withColumn("since", F.min("ts").over(Window.partitionBy("rule", "instance", "_s")))
        return c.where(F.col("ts") >= due).groupBy("rule", "instance", "since").agg(F.min("ts").alias("held_at"))
    known = conditions.groupBy("rule").agg(F.max("ts").alias("_known"))
    runs = c.groupBy("rule", "instance", "_s").agg(F.min("ts").alias("since"), F.first("active").alias("active"))
    runs = runs.withColumn("_ends", F.lead("since").over(Window.partitionBy("rule", "instance").orderBy("_s"))).where("active")
    held = runs.join(small(known), "rule").where((F.col("_known") >= due) & (F.col("_ends").isNull() | (F.col("_ends") > due)))
    return held.select("rule", "instance", "since", due.alias("held_at"))


def suppress(alerts: DataFrame, silences: DataFrame, watermark: str = "10 minutes", forget_seconds: float = 0) -> DataFrame:
    """Alerts (name, ts, ...) outside every silence [from_ts, until_ts) of their name, with first_seen: the first time
    that the name fired (again, if it hadn't for forget_seconds; 0: ever).

    Alerts may be a stream, and silences then a stream, too (or a static table). Alerts wait for the watermark of both
    streams, that is, until no earlier silence can come any more; a silence is state until the watermark passes its end.
    """
    if alerts.isStreaming and silences.isStreaming:
        return stateful.suppress_stream(alerts, silences, watermark, forget_seconds)
    if alerts.isStreaming:
        s = small(silences.select(F.col("name").alias("s_name"), "from_ts", "until_ts"))
        j = alerts.join(s, (F.col("name") == F.col("s_name")) & (F.col("ts") >= F.col("from_ts")) & (F.col("ts") < F.col("until_ts")), "left_outer")
        return stateful.suppress_stream(j.where("s_name IS NULL").select(alerts.columns), None, watermark, forget_seconds)
    kept = enrich.drop_silenced(alerts, silences)
    if not forget_seconds:
        return kept.join(kept.groupBy("name").agg(F.min("ts").alias("first_seen")), "name")
    w = Window.partitionBy("name").orderBy("ts")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    runs = kept.withColumn("_new", F.when(gap < round(forget_seconds * 1e6), 0).otherwise(1)).withColumn("_r", F.sum("_new").over(w))
    return runs.withColumn("first_seen", F.min("ts").over(Window.partitionBy("name", "_r"))).drop("_new", "_r")


def session_signals(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """session_id, start, signal, confidence of sessions by a gap: high_retry_rate (over 3 retries), smooth_completion
    (done, all responses under 5 s), early_abandonment (not done, under 10 s), high_engagement (over 2 follow-ups).

    events: session_id, ts, kind (retry, done, follow_up, ...), response_ms.
    """
    count = lambda k: F.count_if(F.col("kind") == k)
    g = _marked(events, "ts", watermark).groupBy("session_id", F.session_window("ts", gap)).agg(count("retry").alias("retries"), count("done").alias("done"), count("follow_up").alias("follow_ups"), F.max("response_ms").alias("slowest"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("spent"))
    signal = lambda cond, name, c: F.when(cond, F.struct(F.lit(name).alias("signal"), F.lit(c).alias("confidence")))
    found = F.array(
        signal(F.col("retries") > 3, "high_retry_rate", 0.8),
        signal((F.col("done") > 0) & (F.col("slowest") < 5000), "smooth_completion", 0.9),
        signal((F.col("done") == 0) & (F.col("spent") < 10_000_000), "early_abandonment", 0.7),
        signal(F.col("follow_ups") > 2, "high_engagement", 0.75),
    )
    return g.select("session_id", F.col("session_window.start").alias("start"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("session_id", "start", "s.signal", "s.confidence")


def running_stats(runs: DataFrame, key: str = "skill", least: int = 3, rate: float = 0.5) -> DataFrame:
    """Per key runs, success rate, mean time and whether to mend it; a stream runs it in update mode."""
    g = runs.groupBy(key).agg(F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("seconds").alias("mean_seconds"))
    return g.withColumn("mend", (F.col("runs") >= least) & (F.col("success_rate") < rate))


def daily_cost(usage: DataFrame, prices: DataFrame, budgets: DataFrame, watermark: str = "1 day") -> DataFrame:
    """day, scenario, calls, cost, over: tumbling days of priced usage against the scenario's daily budget."""
    priced = enrich.price_usage(usage, prices)
    g = _marked(priced, "ts", watermark).groupBy(F.window("ts", "1 day"), "scenario").agg(F.count("*").alias("calls"), F.sum("cost").cast("double").alias("cost"))
    j = g.join(small(budgets), "scenario", "left")
    return j.select(F.to_date("window.start").alias("day"), "scenario", "calls", "cost", F.coalesce(F.col("cost") > F.col("budget"), F.lit(False)).alias("over"))


def dedup_requests(events: DataFrame, id: str = "request_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """One row per id: the first a stream sees within the watermark; in a batch the earliest."""
    if events.isStreaming:
        return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id])
    rest = [c for c in events.columns if c not in (id, ts)]
    return events.groupBy(id).agg(F.min(F.struct(ts, *rest)).alias("r")).select(id, "r.*").select(events.columns)


def pair_runs_stream(starts: DataFrame, finishes: DataFrame, timeout: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """run_id, task, started_at, finished_at, status (timeout without a finish in time): an outer join bounded in time."""
    s = _marked(starts, "started_at", watermark)
    f = _marked(finishes.withColumnRenamed("run_id", "f_id"), "finished_at", watermark)
    within = (F.col("run_id") == F.col("f_id")) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"INTERVAL {timeout}"))
    return s.join(f, within, "left_outer").select("run_id", "task", "started_at", "finished_at", F.coalesce("status", F.lit("timeout")).alias("status"))


def late(ts: Column, oldest: Column, policy: str = "clamp") -> Column:
    """What a batch does with rows before its first bucket: 'clamp' moves them to it, 'drop' makes them null. Streams
    drop past the watermark."""
    return F.greatest(ts, oldest) if policy == "clamp" else F.when(ts >= oldest, ts)
