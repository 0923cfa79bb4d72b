"""Record logs: a subscription to topics, read as a batch or as a stream.

A log is a folder of Parquet files of schemas.RECORD, or a broker through Spark's own Kafka source where
its connector is on the class path. Both are described by a Subscription; exactly one of a topic list
and a pattern is given.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import RECORD

#: Typed reading of consumer options: name -> default where it isn't given. Fixed values.
OPTION_DEFAULTS = {"max.poll.records": 500, "enable.auto.commit": True, "auto.offset.reset": "latest"}


class ConsumerOptions:
    """Options by name; what is missing or can't be read as the type asked for is None."""

    def __init__(self, options: Mapping[str, object] | None = None):
        self.options = dict(OPTION_DEFAULTS) | dict(options or {})

    def get_int(self, name: str) -> int | None:
        try:
            return int(str(self.options[name]).strip())
        except (KeyError, ValueError):
            return None

    def get_bool(self, name: str) -> bool | None:
        return {"true": True, "false": False}.get(str(self.options.get(name)).strip().lower())


@dataclass(frozen=True)
class Subscription:
    topics: Sequence[str] | None = None
    pattern: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if (self.topics is None) == (self.pattern is None):
            raise ValueError("give exactly one of topics and pattern")
        if self.topics is not None and not self.topics:
            raise ValueError("topics may not be empty")
        if self.pattern is not None:
            re.compile(self.pattern)

    def matches(self) -> Column:
        """Rows of the subscription; a pattern has to match the whole name. Pushed down to the files."""
        if self.topics is not None:
            return F.col("topic").isin(*self.topics)
        return F.col("topic").rlike(f"^(?:{self.pattern})$")

    def kafka_options(self, servers: str, min_partitions: int | None = None) -> dict[str, str]:
        """Options of Spark's Kafka source for this subscription."""
        out = {"kafka.bootstrap.servers": servers}
        out["subscribe" if self.topics is not None else "subscribePattern"] = ",".join(self.topics) if self.topics is not None else str(self.pattern)
        most = ConsumerOptions(self.options).get_int("max.poll.records")
        if most is not None:
            out["maxOffsetsPerTrigger"] = str(most)
        if min_partitions:
            out["minPartitions"] = str(min_partitions)
        known = {"earliest", "latest"}
        reset = str(ConsumerOptions(self.options).options.get("auto.offset.reset"))
        if reset in known:
            out["startingOffsets"] = reset
        return out


def read_log(spark: SparkSession, path: str, subscription: Subscription) -> DataFrame:
    """The subscription's records of a Parquet log."""
    return spark.read.schema(RECORD).parquet(path).where(subscription.matches())


def stream_log(spark: SparkSession, path: str, subscription: Subscription, files_per_batch: int = 1) -> DataFrame:
    """The same as a stream; a micro-batch takes files_per_batch new files, which bounds it."""
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.where(subscription.matches())


def stream_broker(spark: SparkSession, servers: str, subscription: Subscription, min_partitions: int | None = None) -> DataFrame:
    """Records of a broker, keys and values as text. Needs Spark's Kafka connector."""
    raw = spark.readStream.format("kafka").options(**subscription.kafka_options(servers, min_partitions)).load()
    return raw.select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        F.unix_millis("timestamp").alias("timestamp"),
    )


def start_offsets(assigned: DataFrame, committed: DataFrame) -> DataFrame:
    """topic, partition, base: where each assigned partition goes on.

    assigned: topic, partition, position. committed: topic, partition, offset, metadata_ok. The committed
    offset is the next to read, so base is one less; without one it is the position's. What the commit's
    metadata holds beyond base counts only if it could be decoded.
    """
    known = committed.select("topic", "partition", F.col("offset").alias("_next"), "metadata_ok")
    out = assigned.join(known, ["topic", "partition"], "left")
    return out.select(
        "topic", "partition", (F.coalesce("_next", "position") - 1).alias("base"), F.coalesce("metadata_ok", F.lit(False)).alias("restores_snapshot")
    )


def decode_events(values: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """values with the typed event in `event`: JSON text or a null, which stays null. Unknown fields go."""
    return values.withColumn("event", F.from_json(F.col(value).cast("string"), schema, {"mode": "PERMISSIVE"}))


def decode_protobuf(values: DataFrame, message: str, descriptor: str, value: str = "value") -> DataFrame:
    """The same for protobuf bytes, by Spark's own function. Needs its connector on the class path."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return values.withColumn("event", from_protobuf(F.col(value), message, descriptor))
