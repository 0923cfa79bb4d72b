"""Record logs and audit logs derived from the `events` table.

A deterministic load with injected faults, from whole-number arithmetic alone so that another engine
derives the same. Each event is a record of topic user % 3 + 1 (every 37th user: a topic without a
name) and partition user % 4, at the offset that its place in the partition gives. Its outcome follows
from the event's type: purchase and view are processed, click is dropped, error fails, signup has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms
from tidemark.functions.scans import numbered

#: Events of a chunk when offsets are given: a partition's events are numbered by many tasks.
CHUNK = 1 << 20
WINDOW = 500


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log(events: DataFrame) -> DataFrame:
    """event_id, topic_id, partition, offset, message_key, kafka_ts_ms, event_type, delay_ms."""
    rows = events.select(
        "event_id",
        F.when(F.col("user_id") % 37 == 5, 9).otherwise(F.col("user_id") % 3 + 1).cast("int").alias("topic_id"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("user_id").cast("string").alias("message_key"),
        epoch_ms("ts").alias("kafka_ts_ms"),
        "event_type",
        F.floor(F.col("value") * 20).cast("bigint").alias("delay_ms"),
    )
    return numbered(rows, "offset", ["topic_id", "partition"], ["event_id"], F.expr(f"event_id div {CHUNK}"))


def audit_records(events: DataFrame) -> DataFrame:
    """schemas.AUDIT with arrival (audit_ts_ms, event_id, place).

    Faults by event_id: a second C (every 50th), an extra F (70th), no P (90th), a P 100 s late (40th),
    an R (30th), a dry-run P without partition and offset (every 45th from 7).
    """
    every = lambda n, at=0: F.col("event_id") % n == at
    kind = F.when(F.col("event_type").isin("purchase", "view"), "C").when(F.col("event_type") == "click", "D").when(F.col("event_type") == "error", "F")
    reason = F.when(every(4), "stale_age").when(every(4, 1), "queue_overflow").when(every(4, 2), "replaced_by_newer_key_record")
    sent, done = F.col("kafka_ts_ms"), F.col("kafka_ts_ms") + F.col("delay_ms")

    def row(place, t, at, kafka=None, partition="partition", offset="offset", why=None):
        return F.struct(
            F.lit(place).alias("place"),
            (F.lit(t) if isinstance(t, str) else t).alias("record_type"),
            (F.col(partition) if isinstance(partition, str) else F.lit(partition)).cast("int").alias("partition"),
            (F.col(offset) if isinstance(offset, str) else F.lit(offset)).cast("bigint").alias("offset"),
            (kafka if kafka is not None else F.lit(None)).cast("bigint").alias("kafka_ts_ms"),
            at.cast("bigint").alias("audit_ts_ms"),
            (why if why is not None else F.lit(None)).cast("string").alias("drop_reason"),
        )

    made = F.array_compact(
        F.array(
            F.when(~every(90), row(0, "P", sent + F.when(every(40), 100_000).otherwise(0), sent)),
            F.when(every(30), row(1, "R", sent + 1)),
            F.when(kind.isNotNull(), row(2, kind, done, why=F.when(kind == "D", reason))),
            F.when(every(50), row(3, "C", done + 5)),
            F.when(every(70), row(4, "F", done + 9)),
            F.when(every(45, 7), row(5, "P", sent, sent, -1, -1)),
        )
    )
    rows = log(events).select("event_id", "topic_id", "message_key", F.explode(made).alias("r"))
    return rows.select(
        "r.record_type", "topic_id", "r.partition", "r.offset", "r.kafka_ts_ms", "r.audit_ts_ms", "message_key", "r.drop_reason",
        F.struct("r.audit_ts_ms", "event_id", "r.place").alias("arrival"),
    )


#: Milliseconds of a chunk of audit time, for scans along the arrival of audit_records().
SPAN_MS = 3_600_000


def arrival_chunk():
    return F.expr(f"audit_ts_ms div {SPAN_MS}")


def records(events: DataFrame) -> DataFrame:
    """schemas.RECORD-like rows for the processing modes.

    topic, partition, offset, key (null for every 50th user), value (null for every 25th event),
    timestamp_ms, arrival (event_id), window (500 events), now_ms (when the window's last event came).
    """
    rows = log(events).select(
        F.concat(F.lit("topic-"), F.col("topic_id").cast("string")).alias("topic"),
        "partition",
        "offset",
        F.when(F.col("message_key").cast("bigint") % 50 != 0, F.col("message_key")).alias("key"),
        F.when(F.col("event_id") % 25 != 0, F.col("event_type")).alias("value"),
        F.col("kafka_ts_ms").alias("timestamp_ms"),
        F.col("event_id").alias("arrival"),
        F.expr(f"event_id div {WINDOW}").alias("window"),
        "delay_ms",
    )
    ends = rows.groupBy("window").agg(F.max("timestamp_ms").alias("now_ms"))
    return rows.join(ends, "window").select(
        "topic", "partition", "offset", "key", "value", "timestamp_ms", "arrival", "window", "now_ms", "delay_ms"
    )


def completions(records: DataFrame) -> DataFrame:
    """topic, partition, offset of what completed: all but signups and what is null in value by design."""
    return records.where(F.coalesce(F.col("value"), F.lit("")) != "signup").select("topic", "partition", "offset")


def bases(records: DataFrame) -> DataFrame:
    """topic, partition, base: nothing committed yet."""
    return records.groupBy("topic", "partition").agg(F.lit(-1).cast("bigint").alias("base"))
