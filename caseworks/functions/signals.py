"""Labels from ratings, signals, errors, dates and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signals by the sentiment they stand for.
SIGNALS = {
    "positive": ["completion", "success", "quick_accept", "share", "save"],
    "negative": ["correction", "retry", "abandon", "timeout", "error", "complaint"],
    "neutral": ["view", "scroll", "hover"],
}
# Words of a failed run's error by cause; later causes override earlier ones.
CAUSES = [("knowledge_gap", ["not found", "unknown", "missing"]), ("skill_defect", ["error", "exception", "failed", "bug"])]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rating_value(col: Column | str) -> Column:
    """thumbs_up 5, thumbs_down 1, else the leading whole number, else 3."""
    c = _c(col)
    return F.when(c == "thumbs_up", 5).when(c == "thumbs_down", 1).otherwise(F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(3)))


def rating_sentiment(col: Column | str) -> Column:
    v = rating_value(col)
    return F.when(v >= 4, "positive").when(v <= 2, "negative").otherwise("neutral")


def signal_sentiment(signal: Column | str, response_time: Column | str, retries: Column | str, completion: Column | str, signals: dict[str, list[str]] = SIGNALS) -> Column:
    """Sentiment of a known signal; of others by slowness, retries, completion, in this order; else unknown."""
    out = None
    for sentiment in ("positive", "negative", "neutral"):
        hit = _c(signal).isin(signals[sentiment])
        out = F.when(hit, sentiment) if out is None else out.when(hit, sentiment)
    return out.when(_c(response_time) > 10000, "negative").when(_c(retries) > 2, "negative").when(_c(completion) > 0.8, "positive").otherwise("unknown")


def root_cause(success: Column | str, error: Column | str, seconds: Column | str, causes: list = CAUSES) -> Column:
    """success_pattern of a success; of a failure resource_limit beyond 300 s, else the last cause with a word in the error."""
    low = F.lower(_c(error))
    out = F.when(_c(success), "success_pattern").when(_c(seconds) > 300, "resource_limit")
    for cause, words in reversed(causes):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, cause)
    return out.otherwise("unknown")


def triage(df: DataFrame, me: str, approval: str, approver: str, notice: str, notice_from: str) -> DataFrame:
    """Adds level: P0 approval request of a workflow sender, P1 addressed to me, P3 notice, else P2."""
    subject, sender = F.lower(F.coalesce("subject", F.lit(""))), F.lower(F.coalesce("from_addr", F.lit("")))
    to = F.lower(F.coalesce("to_addr", F.lit("")))
    level = F.when(sender.rlike(approver) & subject.rlike(approval), "P0").when(to.contains(me.lower()), "P1").when(subject.rlike(notice) | sender.rlike(notice_from), "P3").otherwise("P2")
    return df.withColumn("level", level)


def delivery_metrics(df: DataFrame, est: str, base: str, actual: str, status: str, abnormal: str) -> DataFrame:
    """Adds for plan (est against base) and delivery (actual against est): days, label, crosses month, penalty.

    A missing other date gives the label 'missing' and null days; without est all are null. Rows that aren't counted
    ('skip') cost 0; the same month and under 15 days cost 0.5 (an exactly met date too); anything else costs 1.
    """

    def pair(name: str, later: str, earlier: str) -> dict[str, Column]:
        days = F.when(F.col(est).isNotNull(), F.datediff(later, earlier))
        label = F.when(F.col(est).isNull(), None).when(days.isNull(), "missing").when(days > 0, "late").when(days < 0, "early").otherwise("same")
        skip = days.isNull() | F.coalesce(F.col(status) == abnormal, F.lit(False))
        cross = F.when(skip, "skip").when(F.trunc(later, "month") == F.trunc(earlier, "month"), "no").otherwise("yes")
        penalty = F.when(skip, 0.0).when((cross == "no") & (F.abs(days) < 15), 0.5).otherwise(1.0)
        return {f"{name}_days": days, f"{name}_label": label, f"{name}_cross": cross, f"{name}_penalty": penalty}

    return df.withColumns(pair("plan", est, base) | pair("delivery", actual, est))


def duration_bucket(start: Column | str, end: Column | str, bounds: tuple[int, ...] = (90, 180, 365)) -> Column:
    """Days from start to end (0 at least) as '<=90', '<=180', '<=365' or '>365'."""
    days = F.greatest(F.lit(0), F.datediff(end, start))
    out = None
    for b in bounds:
        out = F.when(days <= b, f"<={b}") if out is None else out.when(days <= b, f"<={b}")
    return out.when(days > bounds[-1], f">{bounds[-1]}")
