"""Metric series from record outcomes: timers, counters, gauges, and quantiles of histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import metric_name, referenced_metrics

#: Tag keys that series carry anyway. Fixed values.
RESERVED_TAGS = ("consumer_id", "topic", "error", "attempt", "success", "reason")
#: suffix -> kind of series. Fixed values.
CATALOGUE = {
    "record.process.duration": "timer",
    "record.end.to.end.duration": "timer",
    "record.failed.duration": "timer",
    "record.dropped": "counter",
    "record.retry": "counter",
    "poll.duration": "timer",
    "poll.records": "summary",
    "commit.duration": "timer",
    "commit.partitions": "summary",
    "commit.offsets": "summary",
    "pause.resume": "counter",
    "pause.resume.partitions": "summary",
    "failure": "counter",
    "workers": "gauge",
    "workers.active": "gauge",
    "work.queue.size": "gauge",
    "work.queue.capacity": "gauge",
    "work.queue.max": "gauge",
    "ordering.queue.size": "gauge",
    "ordering.queue.max": "gauge",
    "offsettracker.capacity": "gauge",
}


@dataclass(frozen=True)
class TagDefinition:
    key: str
    default: str = "NONE"

    def __post_init__(self) -> None:
        if not self.key.strip():
            raise ValueError("a tag key may not be blank")
        if self.key in RESERVED_TAGS:
            raise ValueError(f"tag key {self.key!r} is reserved")


class TagSchema:
    """Declared tags, each with a default, and per consumer the expressions that fill them.

    All series of one schema have the same tags. An expression for an undeclared tag is an error; a
    tag without one, or with a null value, has its default.
    """

    def __init__(self, prefix: str, tags: Sequence[TagDefinition] = (), static: Mapping[str, str] | None = None, family: str = "consumer"):
        keys = [t.key for t in tags]
        repeated = sorted({k for k in keys if keys.count(k) > 1})
        if repeated:
            raise ValueError(f"tags are declared more than once: {', '.join(repeated)}")
        self.prefix, self.tags, self.static, self.family = prefix, tuple(tags), dict(static or {}), family

    def columns(self, extractors: Mapping[str, Column] | None = None) -> list[Column]:
        extractors = extractors or {}
        unknown = sorted(set(extractors) - {t.key for t in self.tags})
        if unknown:
            raise ValueError(f"expressions for undeclared tags: {', '.join(unknown)}")
        found = [F.coalesce(extractors.get(t.key, F.lit(None)).cast("string"), F.lit(t.default)).alias(t.key) for t in self.tags]
        return found + [F.lit(v).alias(k) for k, v in self.static.items()]

    def name(self, suffix: str) -> Column:
        return metric_name(F.lit(suffix), self.prefix, self.family)


def timer(rows: DataFrame, value: Column, by: Sequence[str], name: Column | None = None) -> DataFrame:
    """by, count, total and max of a duration or a size; metric first if it has a name."""
    head = [name.alias("metric")] if name is not None else []
    out = rows.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("total"), F.max(value).alias("max"))
    return out.select(*head, *by, "count", "total", "max")


def counter(rows: DataFrame, by: Sequence[str], name: Column | None = None) -> DataFrame:
    head = [name.alias("metric")] if name is not None else []
    return rows.groupBy(*by).agg(F.count("*").alias("count")).select(*head, *by, "count")


def record_timers(outcomes: DataFrame, schema: TagSchema, consumer_id: str, extractors: Mapping[str, Column] | None = None) -> DataFrame:
    """metric, consumer_id, topic, tags, error, count, total_ms, max_ms of processed and failed records.

    outcomes: topic, outcome (processed, failed), duration_ms, end_to_end_ms, error. One aggregation: a
    record's one or two series are exploded and combined before the shuffle.
    """
    keys = [t.key for t in schema.tags] + list(schema.static)
    done = F.col("outcome") == "processed"
    series = F.array_compact(
        F.array(
            F.when(done, F.struct(F.lit("record.process.duration").alias("suffix"), F.col("duration_ms").alias("ms"))),
            F.when(done, F.struct(F.lit("record.end.to.end.duration").alias("suffix"), F.col("end_to_end_ms").alias("ms"))),
            F.when(F.col("outcome") == "failed", F.struct(F.lit("record.failed.duration").alias("suffix"), F.col("duration_ms").alias("ms"))),
        )
    )
    error = F.when(F.col("outcome") == "failed", F.coalesce("error", F.lit("unknown")))
    rows = outcomes.select("topic", *schema.columns(extractors), error.alias("error"), F.explode(series).alias("s"))
    out = rows.groupBy("topic", *keys, "error", F.col("s.suffix").alias("suffix")).agg(
        F.count("*").alias("count"), F.sum("s.ms").cast("bigint").alias("total_ms"), F.max("s.ms").cast("bigint").alias("max_ms")
    )
    name = metric_name(F.col("suffix"), schema.prefix, schema.family)
    return out.select(name.alias("metric"), F.lit(consumer_id).alias("consumer_id"), "topic", *keys, "error", "count", "total_ms", "max_ms")


def drop_counters(decided: DataFrame, schema: TagSchema, consumer_id: str) -> DataFrame:
    """Dropped records by topic and reason; custom tags don't apply."""
    rows = decided.where("outcome = 'dropped'")
    out = counter(rows, ["topic", "reason"], schema.name("record.dropped"))
    return out.select("metric", F.lit(consumer_id).alias("consumer_id"), "topic", "reason", "count")


def retry_counters(retries: DataFrame, schema: TagSchema, consumer_id: str, extractors: Mapping[str, Column] | None = None) -> DataFrame:
    """retries: topic, attempt, error, one row an attempt."""
    keys = [t.key for t in schema.tags] + list(schema.static)
    rows = retries.select("topic", *schema.columns(extractors), "attempt", "error")
    out = counter(rows, ["topic", *keys, "attempt", "error"], schema.name("record.retry"))
    return out.select("metric", F.lit(consumer_id).alias("consumer_id"), "topic", *keys, "attempt", "error", "count")


def model_calls(calls: DataFrame) -> DataFrame:
    """Timers of external model calls. calls: model, operation, client_mode, transport, outcome, duration_ms."""
    return timer(calls, F.col("duration_ms"), ["model", "operation", "client_mode", "transport", "outcome"])


def increase(samples: DataFrame, by: Sequence[str], start_ms: Column | int, end_ms: Column | int) -> DataFrame:
    """by and increase of a counter's samples (by, value, timestamp_ms) between two times, restarts added up.

    A value lower than the one before is a restart from 0.
    """
    lo = F.lit(start_ms) if isinstance(start_ms, int) else start_ms
    hi = F.lit(end_ms) if isinstance(end_ms, int) else end_ms
    rows = samples.where(F.col("timestamp_ms").between(lo, hi) & finite("value"))
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("timestamp_ms"))
    rows = rows.withColumn("_step", F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")))
    return rows.groupBy(*by).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("increase"))


def average_rate(increases: DataFrame, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """by and per_second: the sum of the series' increases over the time."""
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    return increases.groupBy(*by).agg((F.sum("increase") / F.lit(float(seconds))).alias("per_second"))


def bucket_counts(values: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, le, count: cumulative buckets of a histogram, the last unbounded.

    Counted by bucket first (one row a bucket and task is shuffled), then summed up along the bounds.
    """
    edges = sorted(float(b) for b in bounds) + [float("inf")]
    first = F.coalesce(*(F.when(F.col(value) <= b, F.lit(b)) for b in edges[:-1]), F.lit(edges[-1]))
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, first.alias("le")).agg(F.count("*").alias("n"))
    groups = counted.select(*by).distinct() if by else None
    grid = F.explode(F.array(*(F.lit(e) for e in edges))).alias("le")
    every = groups.select(*by, grid) if by else counted.sparkSession.range(1).select(grid)
    full = every.join(counted, [*by, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, "le", F.sum("n").over(upto).cast("bigint").alias("count"))


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """by and value: the q-quantile of cumulative buckets (by, le, count), linear inside a bucket.

    In the unbounded bucket it is the highest bound; with no observation it is null. The first bucket
    starts at 0 if its bound is positive, and is its bound otherwise.
    """
    if not 0 <= q <= 1:
        raise ValueError("q is between 0 and 1")
    order = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    rows = buckets.withColumns(
        {
            "_below": F.coalesce(F.lag("count").over(order), F.lit(0)),
            "_from": F.lag("le").over(order),
            "_all": F.max("count").over(whole),
        }
    )
    rows = rows.withColumn("_rank", F.lit(float(q)) * F.col("_all"))
    hit = rows.where((F.col("count") >= F.col("_rank")) & (F.col("_all") > 0))
    first = hit.groupBy(*by).agg(F.min(F.struct("le", "_below", "_from", "count", "_rank")).alias("b"))
    low = F.coalesce("b._from", F.when(F.col("b.le") > 0, F.lit(0.0)))
    width = F.col("b.count") - F.col("b._below")
    inside = low + (F.col("b.le") - low) * F.when(width > 0, (F.col("b._rank") - F.col("b._below")) / width).otherwise(F.lit(0.0))
    value = F.when(F.col("b.le") == float("inf"), F.col("b._from")).when(low.isNull(), F.col("b.le")).otherwise(inside)
    return first.select(*by, value.alias("value"))


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def dashboard_metrics(expressions: DataFrame, column: str = "expression") -> DataFrame:
    """metric: every metric name that the expressions mention, once, in order."""
    return expressions.select(F.explode(referenced_metrics(column)).alias("metric")).distinct().orderBy("metric")


def scalar(samples: DataFrame, value: str = "value") -> DataFrame:
    """One row, value: the sum of the finite values; null if there is none."""
    return samples.where(finite(value)).agg(F.sum(value).alias("value"))


def in_window(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Samples from start to end, both included."""
    return samples.where(F.col("timestamp_ms").between(start_ms, end_ms))


def standard_measurements(outcomes: DataFrame, start_ms: int, seconds: float, bounds: Sequence[float]) -> DataFrame:
    """One row: latency_p95_ms, latency_p99_ms and throughput_average_rps of the outcomes in a window.

    outcomes: processed_ms, end_to_end_ms. Latencies are quantiles of a histogram with these bounds.
    """
    rows = outcomes.where((F.col("processed_ms") >= start_ms) & (F.col("processed_ms") <= F.lit(start_ms) + F.lit(int(seconds * 1000))))
    buckets = bucket_counts(rows, "end_to_end_ms", bounds)
    q95 = histogram_quantile(buckets, 0.95).select(F.lit("latency_p95_ms").alias("measurement"), "value")
    q99 = histogram_quantile(buckets, 0.99).select(F.lit("latency_p99_ms").alias("measurement"), "value")
    rate = rows.agg((F.count("*") / F.lit(float(max(1.0, seconds)))).alias("value"))
    return q95.unionByName(q99).unionByName(rate.select(F.lit("throughput_average_rps").alias("measurement"), "value"))


def stage_counts(entities: DataFrame, stage: str, stages: Sequence[str]) -> DataFrame:
    """One row, a column for each stage: how many entities are in it."""
    return entities.agg(*(F.count_if(F.col(stage) == s).alias(s.replace(".", "_")) for s in stages))


def generator_counters(emits: DataFrame) -> DataFrame:
    """generator, total, emitted, delegated, blocked. emits: generator, emitted (count), delegated, blocked."""
    return emits.groupBy("generator").agg(
        F.count("*").alias("total"),
        F.sum("emitted").cast("bigint").alias("emitted"),
        F.sum("delegated").cast("bigint").alias("delegated"),
        F.count_if("blocked").alias("blocked"),
    )


def publisher_counters(sends: DataFrame) -> DataFrame:
    """stream, sent, acked, failed. sends: stream, outcome (acked, failed, or null while pending)."""
    return sends.groupBy("stream").agg(
        F.count("*").alias("sent"), F.count_if(F.col("outcome") == "acked").alias("acked"), F.count_if(F.col("outcome") == "failed").alias("failed")
    )
