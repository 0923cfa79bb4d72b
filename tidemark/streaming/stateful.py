"""Stateful streaming operators: pending records by key, drain windows, matching with a time to live.

They are keyed: a key's state is one row of the state store, which Spark moves and restores with its
partition. Event time drives them, so a replay of the same files gives the same result; the watermark
comes from the records' own time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.modes import key_lane

DECISION = "topic string, partition int, offset bigint, key string, timestamp bigint, outcome string, reason string"
_RECORD = "topic string, partition int, offset bigint, key string, timestamp bigint"


class PendingByKey(StatefulProcessor):
    """One pending record a key and drain window; a newer one replaces it, the timer drains it.

    Rows of a call come in any order, so "newer" is by (timestamp, topic, partition, offset).
    """

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "window bigint", _RECORD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["timestamp", "topic", "partition", "offset"]).itertuples():
                window = r.timestamp // self.window_ms
                row = (r.topic, int(r.partition), int(r.offset), None if pd.isna(r.key) else r.key, int(r.timestamp))
                if self.pending.containsKey((window,)):
                    held = tuple(self.pending.getValue((window,)))
                    newer, older = (row, held) if _order(row) > _order(held) else (held, row)
                    out.append((*older, "dropped", "replaced_by_newer_key_record"))
                    self.pending.updateValue((window,), newer)
                else:
                    self.pending.updateValue((window,), row)
                    self.handle.registerTimer((window + 1) * self.window_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        window = expiredTimerInfo.getExpiryTimeInMs() // self.window_ms - 1
        out = []
        if self.pending.containsKey((window,)):
            out.append((*tuple(self.pending.getValue((window,))), "processed", None))
            self.pending.removeKey((window,))
        yield _frame(out)

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    return row[4], row[0], row[1], row[2]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["topic", "partition", "offset", "key", "timestamp", "outcome", "reason"]).astype({"partition": "int32", "offset": "int64", "timestamp": "int64"})


def replace_pending_stream(records: DataFrame, window_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """DECISION of a stream of records: the newest of a key in each drain window is processed.

    records: topic, partition, offset, key, timestamp (ms). Drained when the watermark passes the window's
    end. No capacity: admission over keys is a batch's decision (operators.modes.replace_pending).
    """
    timed = records.select("topic", "partition", "offset", "key", "timestamp", key_lane().alias("lane"), F.timestamp_millis("timestamp").alias("event_time"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy("lane")
        .transformWithStateInPandas(PendingByKey(window_ms), DECISION, outputMode="Append", timeMode="EventTime")
    )


MATCH = "topic_id int, partition int, offset bigint, published boolean, processed boolean, failed boolean, dropped boolean, first_ms bigint, last_ms bigint"


class BoundedMatch(StatefulProcessor):
    """One (topic, partition, offset): kinds seen until nothing comes for ttl_ms; then a row is emitted.

    The time between a key's own records decides, so the result doesn't depend on how they fall into
    micro-batches; the timer, which follows the watermark, only ends what nothing follows.
    """

    KINDS = ("P", "C", "F", "D")

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "p boolean, c boolean, f boolean, d boolean, first_ms bigint, last_ms bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = sorted((int(t), k) for pdf in rows for t, k in zip(pdf["audit_ts_ms"], pdf["record_type"], strict=True) if k in self.KINDS)
        out, now, timer = [], None, None
        if came and self.seen.exists():
            *flags, first, last, timer = tuple(self.seen.get())
            now = [flags, first, last]
        for at, kind in came:
            if now is not None and at - now[2] > self.ttl_ms:
                out.append((*key, *now[0], now[1], now[2]))
                now = None
            if now is None:
                now = [[False] * len(self.KINDS), at, at]
            now[0][self.KINDS.index(kind)] = True
            now[1], now[2] = min(now[1], at), max(now[2], at)
        if now is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = now[2] + self.ttl_ms + 1
            self.handle.registerTimer(timer)
            self.seen.update((*now[0], now[1], now[2], timer))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        rows = []
        if self.seen.exists():
            p, c, f, d, first, last, _ = tuple(self.seen.get())
            rows.append((*key, p, c, f, d, first, last))
            self.seen.clear()
        yield self._frame(rows)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["topic_id", "partition", "offset", "published", "processed", "failed", "dropped", "first_ms", "last_ms"]
        types = {"topic_id": "int32", "partition": "int32", "offset": "int64", "first_ms": "int64", "last_ms": "int64"}
        return pd.DataFrame(rows, columns=names).astype(types | {c: bool for c in names[3:7]})

    def close(self) -> None:
        pass


def bounded_match_stream(records: DataFrame, ttl_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """MATCH of a stream of audit records (schemas.AUDIT): a key's row once nothing came for ttl_ms.

    published without an outcome is missing; an outcome without published is without publish. A late
    outcome starts a row of its own.
    """
    if ttl_ms <= 0:
        raise ValueError("ttl_ms must be positive")
    usable = records.where((F.col("partition") >= 0) & (F.col("offset") >= 0) & (F.col("record_type") != "R"))
    timed = usable.select("topic_id", "partition", "offset", "record_type", "audit_ts_ms", F.timestamp_millis("audit_ts_ms").alias("event_time"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy("topic_id", "partition", "offset")
        .transformWithStateInPandas(BoundedMatch(ttl_ms), MATCH, outputMode="Append", timeMode="EventTime")
    )


def drain_window_counts(records: DataFrame, window: str, lateness: str = "0 seconds") -> DataFrame:
    """window_start_ms, topic, records, keys_about of a stream, once the watermark passes a window.

    Spark's own tumbling windows; distinct keys are estimated, as exact ones would be state without bound.
    """
    timed = records.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", lateness)
    out = timed.groupBy(F.window("event_time", window), "topic").agg(F.count("*").alias("records"), F.approx_count_distinct("key").alias("keys_about"))
    return out.select(F.unix_millis("window.start").alias("window_start_ms"), "topic", "records", "keys_about")


def exactly_once(records: DataFrame) -> DataFrame:
    """A stream without records that were processed before: state of every (topic, partition, offset).

    No watermark: a record is never forgotten, as forgetting would let a replay in; what bounds the state
    is the log itself. With a log kept for a time, use dropDuplicatesWithinWatermark over that time.
    """
    return records.dropDuplicates(["topic", "partition", "offset"])
