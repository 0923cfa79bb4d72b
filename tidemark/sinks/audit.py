"""Audit logs out of records: the exact lines that sources.audit reads."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode() -> Column:
    """The line of a row of schemas.AUDIT. A null key is empty; a blank reason is left out."""
    key = F.coalesce("message_key", F.lit(""))
    place = [F.col(c).cast("string") for c in ("record_type", "topic_id", "partition", "offset")]
    at = F.col("audit_ts_ms").cast("string")
    reason = F.when((F.col("record_type") == "D") & F.col("drop_reason").rlike(r"\S"), F.col("drop_reason"))
    return F.when(
        F.col("record_type") == "P", F.concat_ws("|", *place, F.col("kafka_ts_ms").cast("string"), at, key)
    ).otherwise(F.concat_ws("|", *place, at, key, reason))


def write_audit(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder of log files; a task's rows stay in their order."""
    records.select(encode().alias("value")).write.option("compression", compression).text(path)


def outcome_records(decided: DataFrame, topic_id: Column, audit_ts_ms: Column) -> DataFrame:
    """schemas.AUDIT of decided records (see operators.modes): C for processed with a value, D for dropped."""
    kind = F.when(F.col("outcome") == "dropped", "D").when(F.col("outcome") == "failed", "F").when(F.col("value").isNotNull(), "C")
    rows = decided.withColumn("record_type", kind).where("record_type is not null")
    return rows.select(
        "record_type", topic_id.cast("int").alias("topic_id"), "partition", "offset", F.lit(None).cast("bigint").alias("kafka_ts_ms"),
        audit_ts_ms.cast("bigint").alias("audit_ts_ms"), F.col("key").alias("message_key"), F.lower("reason").alias("drop_reason"),
    )


def published_records(records: DataFrame, topic_id: Column, audit_ts_ms: Column) -> DataFrame:
    """schemas.AUDIT of what a broker acknowledged."""
    return records.select(
        F.lit("P").alias("record_type"), topic_id.cast("int").alias("topic_id"), "partition", "offset",
        F.col("timestamp").cast("bigint").alias("kafka_ts_ms"), audit_ts_ms.cast("bigint").alias("audit_ts_ms"),
        F.col("key").alias("message_key"), F.lit(None).cast("string").alias("drop_reason"),
    )


def shutdown_marker(phase: str, now_ms: int | None = None) -> str:
    return f"S|shutdown|{phase}|{int(time.time() * 1000) if now_ms is None else now_ms}"
