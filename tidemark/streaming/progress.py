"""What a running query tells about itself: polls, batch sizes, time, and the end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.metrics import TagSchema
from tidemark.sinks.audit import shutdown_marker

PROGRESS = "consumer_id string, batch_id bigint, rows bigint, poll_ms bigint, commit_ms bigint, batch_ms bigint"


class ProgressListener(StreamingQueryListener):
    """Keeps the last `keep` progress reports; on the end of a query hands a shutdown marker to `on_end`.

    Register it with spark.streams.addListener(). It holds numbers of micro-batches, not records.
    """

    def __init__(self, keep: int = 10_000, on_end: Callable[[str], None] | None = None):
        self.rows: list[tuple] = []
        self.keep, self.on_end = keep, on_end

    def onQueryStarted(self, event) -> None:  # noqa: N802  the interface's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        took = json.loads(p.json).get("durationMs", {})
        read = sum(took.get(k, 0) for k in ("latestOffset", "getBatch"))
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, read, took.get("commitOffsets", 0), took.get("triggerExecution", 0)))
        del self.rows[: -self.keep]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.on_end is not None:
            self.on_end(shutdown_marker("failed" if event.exception else "stopped"))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS)


def poll_metrics(progress: DataFrame, schema: TagSchema) -> DataFrame:
    """metric, consumer_id, count, total, max of polls (time and rows) and commits."""
    series = F.array(
        F.struct(F.lit("poll.duration").alias("suffix"), F.col("poll_ms").alias("v")),
        F.struct(F.lit("poll.records").alias("suffix"), F.col("rows").alias("v")),
        F.struct(F.lit("commit.duration").alias("suffix"), F.col("commit_ms").alias("v")),
    )
    rows = progress.select("consumer_id", F.explode(series).alias("s"))
    out = rows.groupBy("consumer_id", F.col("s.suffix").alias("suffix")).agg(F.count("*").alias("count"), F.sum("s.v").alias("total"), F.max("s.v").alias("max"))
    return out.select(F.concat_ws(".", F.lit(schema.prefix or None), F.lit(schema.family), "suffix").alias("metric"), "consumer_id", "count", "total", "max")
