"""Keyed state over event time: samples of a key wait in a list until the watermark has passed them, are then worked off in
order of time, and timers act where no further sample comes. So rows may arrive out of order, within and across batches,
and the results are those of a sorted batch.

Needs the RocksDB state store (`use_rocksdb`). Times are kept as whole microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "rule string, instance string, since timestamp, held_at timestamp"
#: An active sample that hasn't begun a stretch, as a time.
NONE = np.iinfo(np.int64).min


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB, unless the session names a provider itself."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _stamps(micros: np.ndarray) -> pd.Series:
    return pd.Series(pd.to_datetime(micros, unit="us"))


class _Ordered(StatefulProcessor):
    """Rows of a key that wait for the watermark, in the list state `waiting`, with a timer at the earliest of them."""

    def _wait(self, rows: list[tuple], watermark_ms: int) -> None:
        """rows: tuples whose first value is the time."""
        if rows:
            self.waiting.appendList(rows)
            self._wake(min(r[0] for r in rows), watermark_ms)

    def _wake(self, micros: int, watermark_ms: int) -> None:
        """A timer at the first millisecond that isn't before the time, nor passed already."""
        self.handle.registerTimer(max(-(-micros // 1000), watermark_ms + 1))

    def _released(self, watermark_ms: int) -> list[tuple]:
        """The waiting rows that the watermark has passed, in order; the others go on waiting."""
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(tuple(r) for r in held if r[0] <= watermark_ms * 1000)
        rest = [tuple(r) for r in held if r[0] > watermark_ms * 1000]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self._wake(min(r[0] for r in rest), watermark_ms)
        return ready


def stretches(ts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of the runs of active samples."""
    edge = np.diff(np.concatenate([[False], active, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class HeldFor(_Ordered):
    """held_for over a stream. State of a key: its waiting samples, the start of the open stretch, the time of the last
    sample, and whether the stretch has fired. A key without an open stretch and without waiting samples has no state."""

    def __init__(self, micros: int, at: str, idle_micros: int) -> None:
        self.micros, self.at, self.idle = micros, at, idle_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, active boolean")
        self.open = handle.getValueState("open", "since long, last long, fired boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self._wait(list(zip(pdf["us"].tolist(), pdf["active"].tolist(), strict=True)), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        since, last, fired = self.open.get() if self.open.exists() else (NONE, NONE, False)
        ready = self._released(mark)
        ts = np.array([r[0] for r in ready], np.int64)
        active = np.array([r[1] for r in ready], bool)
        if since != NONE:  # the open stretch goes on
            ts, active = np.concatenate([[since, last], ts]), np.concatenate([[True, True], active])
        first, to = stretches(ts, active)
        begun, due = ts[first], ts[first] + self.micros
        if self.at == "sample":
            hit = np.searchsorted(ts, due)  # each stretch's first sample that shows it
            ok, when = hit < to, ts[np.minimum(hit, max(0, len(ts) - 1))]
        else:
            ends = np.append(ts, mark * 1000 + 1)[to]  # the sample that ends it, or as far as is known
            ok, when = due < ends, due
        if len(first) and since != NONE and fired:
            ok[0] = False  # once a stretch
        still = len(to) > 0 and to[-1] == len(ts)
        idle = still and self.idle and mark * 1000 >= ts[-1] + self.idle
        if still and not idle:
            done = bool(ok[-1]) or (fired and len(first) == 1 and since != NONE)
            self.open.update((int(begun[-1]), int(ts[-1]), done))
            if self.at == "deadline" and not done:
                self._wake(int(due[-1]), mark)
            if self.idle:
                self._wake(int(ts[-1]) + self.idle, mark)
        else:
            self.open.clear()
        if ok.any():
            n = int(ok.sum())
            yield pd.DataFrame({"rule": [key[0]] * n, "instance": [key[1]] * n, "since": _stamps(begun[ok]), "held_at": _stamps(when[ok])})

    def close(self) -> None:
        pass


def held_stream(conditions: DataFrame, seconds: float, watermark: str, at: str, idle_seconds: float) -> DataFrame:
    use_rocksdb(conditions.sparkSession)
    marked = conditions.withWatermark("ts", watermark).select("rule", "instance", "ts", F.unix_micros("ts").alias("us"), "active")
    processor = HeldFor(round(seconds * 1e6), at, round(idle_seconds * 1e6))
    return marked.groupBy("rule", "instance").transformWithStateInPandas(processor, HELD, "append", "EventTime")


class Suppress(_Ordered):
    """suppress over two streams. State of a name: its waiting alerts, its silences, and the first time that it fired. A
    silence goes when the watermark has passed its end, the first time after `forget` without an alert."""

    def __init__(self, forget_micros: int) -> None:
        self.forget = forget_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, row string")
        self.silences = handle.getListState("silences", "from_us long, until_us long")
        self.first = handle.getValueState("first", "ts long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            said = pdf[pdf["until_us"].notna()]
            if len(said):
                self.silences.appendList(list(zip(said["us"].astype("int64").tolist(), said["until_us"].astype("int64").tolist(), strict=True)))
                self._wake(int(said["until_us"].min()), mark)
            alerts = pdf[pdf["until_us"].isna()]
            self._wait(list(zip(alerts["us"].tolist(), alerts["row"].tolist(), strict=True)), mark)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready = self._released(mark)
        held = np.array([tuple(s) for s in self.silences.get()] if self.silences.exists() else [], np.int64).reshape(-1, 2)
        ts = np.array([r[0] for r in ready], np.int64)
        kept = ~((ts[:, None] >= held[:, 0]) & (ts[:, None] < held[:, 1])).any(1)
        first, last = self.first.get() if self.first.exists() else (NONE, NONE)
        firsts = np.zeros(len(ts), np.int64)
        for i in np.flatnonzero(kept).tolist():
            if first == NONE or (self.forget and ts[i] - last >= self.forget):
                first = int(ts[i])
            firsts[i], last = first, int(ts[i])
        open_ = held[held[:, 1] > mark * 1000]
        if len(open_) < len(held):
            if len(open_):
                self.silences.put([tuple(map(int, s)) for s in open_])
                self._wake(int(open_[:, 1].min()), mark)
            else:
                self.silences.clear()
        if first != NONE and self.forget and mark * 1000 >= last + self.forget and not self.waiting.exists():
            self.first.clear()
        elif first != NONE:
            self.first.update((first, last))
            if self.forget:
                self._wake(last + self.forget, mark)
        if kept.any():
            yield pd.DataFrame({"row": [r[1] for r, k in zip(ready, kept, strict=True) if k], "first_seen": _stamps(firsts[kept])})

    def close(self) -> None:
        pass


_AS_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def suppress_stream(alerts: DataFrame, silences: DataFrame | None, watermark: str, forget_seconds: float) -> DataFrame:
    use_rocksdb(alerts.sparkSession)
    row = F.to_json(F.struct(*alerts.columns), _AS_JSON)
    marked = alerts.select("name", "ts", row.alias("row"), F.lit(None).cast("long").alias("until_us")).withWatermark("ts", watermark)
    if silences is not None:
        said = silences.select("name", F.col("from_ts").alias("ts"), F.lit(None).cast("string").alias("row"), F.unix_micros("until_ts").alias("until_us"))
        marked = marked.unionByName(said.where("until_us IS NOT NULL").withWatermark("ts", watermark))
    marked = marked.withColumn("us", F.unix_micros("ts"))
    out = marked.groupBy("name").transformWithStateInPandas(Suppress(round(forget_seconds * 1e6)), "row string, first_seen timestamp", "append", "EventTime")
    return out.select(F.from_json("row", alerts.schema, _AS_JSON).alias("r"), "first_seen").select("r.*", "first_seen")
