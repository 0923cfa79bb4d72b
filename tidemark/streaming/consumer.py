"""Consumers: a subscription, a processing mode, a handler, retries and a failure branch, as one query.

A micro-batch is a drain window. Its records are decided by the mode's function, those to be processed
go through the handler on the executors (in lanes where the mode has them), and outcomes are written as
audit records. Progress is Spark's checkpoint: a batch counts once its outcomes are written, so a
restart may repeat a batch, as at-least-once delivery does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.modes import Mode, ModeOptions, apply_mode
from tidemark.sources.records import ConsumerOptions, Subscription, stream_log


@dataclass(frozen=True)
class RetryRule:
    """Up to max_retries further attempts for these errors, with a fixed delay."""

    errors: tuple[type[BaseException], ...]
    max_retries: int = 0
    delay_seconds: float = 0.0

    def __post_init__(self) -> None:
        if not self.errors:
            raise ValueError("a retry rule names errors")
        if self.max_retries < 0 or self.delay_seconds < 0:
            raise ValueError("retries and delay may not be negative")


@dataclass(frozen=True)
class RetryPolicy:
    rules: tuple[RetryRule, ...] = ()

    def rule_for(self, error: BaseException) -> RetryRule | None:
        """The first rule that fits."""
        return next((r for r in self.rules if isinstance(error, r.errors)), None)


def retry(*errors: type[BaseException], max_retries: int = 0, delay_seconds: float = 0.0) -> RetryRule:
    return RetryRule(errors, max_retries, delay_seconds)


class Metrics:
    """Callbacks; the default does nothing. Those of records run where the records are handled."""

    def on_processed(self, record: Mapping, duration_ms: float, end_to_end_ms: int) -> None: ...
    def on_failed(self, record: Mapping, error: BaseException, duration_ms: float) -> None: ...
    def on_retry(self, record: Mapping, attempt: int, error: BaseException) -> None: ...
    def on_batch(self, batch_id: int, counts: Mapping[str, int]) -> None: ...
    def on_consumer_failure(self, error: BaseException) -> None: ...


#: Outcome columns of a handled record; attempts is 1 for a first success.
OUTCOME = "topic string, partition int, offset bigint, key string, value string, timestamp bigint, outcome string, reason string, attempts int, error string, duration_ms double"
HANDLED = ["topic", "partition", "offset", "key", "value", "timestamp"]


@dataclass(frozen=True)
class Handling:
    """How one record is handled: attempts, then the failure branch; a failing branch fails the task."""

    handler: Callable[[Mapping], object]
    policy: RetryPolicy = RetryPolicy()
    on_failure: Callable[[Mapping, BaseException], None] | None = None
    context: Callable[[Mapping, Callable[[], tuple]], tuple] | None = None
    metrics: Metrics = field(default_factory=Metrics)
    sleep: Callable[[float], None] = time.sleep
    clock_ms: Callable[[], float] = lambda: time.time() * 1000

    def run(self, record: Mapping) -> tuple[str, int, str | None, float]:
        """(outcome, attempts, error, duration_ms)."""
        if self.context is not None:
            return self.context(record, lambda: self._direct(record))
        return self._direct(record)

    def _direct(self, record: Mapping) -> tuple[str, int, str | None, float]:
        began, attempts = time.perf_counter(), 0
        while True:
            attempts += 1
            try:
                if record["value"] is not None:
                    self.handler(record)
            except Exception as error:
                rule = self.policy.rule_for(error)
                if rule is not None and attempts <= rule.max_retries:
                    self.metrics.on_retry(record, attempts, error)
                    if rule.delay_seconds:
                        self.sleep(rule.delay_seconds)
                    continue
                if self.on_failure is not None:
                    self.on_failure(record, error)
                took = (time.perf_counter() - began) * 1000
                self.metrics.on_failed(record, error, took)
                return "failed", attempts, type(error).__name__, took
            took = (time.perf_counter() - began) * 1000
            self.metrics.on_processed(record, took, max(0, int(self.clock_ms() - (record["timestamp"] or 0))))
            return "processed", attempts, None, took


def handle(decided: DataFrame, handling: Handling, ordered: bool) -> DataFrame:
    """OUTCOME of every decided record. With lanes, a lane's records are handled by one task in order.

    Lanes are dealt out by hash and sorted inside a task: a hot lane is one task's work by the
    contract, which asks for one record of it at a time.
    """
    todo, rest = decided.where("outcome = 'processed'"), decided.where("outcome = 'dropped'")
    if ordered:
        todo = todo.repartition("lane").sortWithinPartitions("lane", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record in pdf[HANDLED].astype(object).where(pdf[HANDLED].notna(), None).to_dict("records"):
                outcome, attempts, error, took = handling.run(record)
                rows.append((*(record[c] for c in HANDLED), outcome, None, attempts, error, took))
            yield pd.DataFrame(rows, columns=[*HANDLED, "outcome", "reason", "attempts", "error", "duration_ms"])

    done = todo.select(*HANDLED).mapInPandas(run, OUTCOME)
    dropped = rest.select(
        *HANDLED, "outcome", "reason", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("duration_ms")
    )
    return done.unionByName(dropped)


class Consumer:
    """consumer(spark, path).topics("a", "b").mode(...).handle(fn).retry(...).start(...)"""

    def __init__(self, spark: SparkSession, path: str, options: Mapping[str, object] | None = None):
        self.spark, self.path, self.options = spark, path, dict(options or {})
        self._topics: list[str] | None = None
        self._pattern: str | None = None
        self._mode = Mode.AT_LEAST_ONCE_NO_ORDERING
        self._capacity, self._max_age_ms, self._files, self._interval = 1024, None, 1, 5.0
        self._handling = Handling(lambda record: None)
        self.counts: dict[str, int] = {}
        self.failure: BaseException | None = None
        self.query: StreamingQuery | None = None

    def topics(self, *names: str) -> Consumer:
        self._topics = list(names)
        return self

    def topics_pattern(self, pattern: str) -> Consumer:
        self._pattern = pattern
        return self

    def mode(self, mode: Mode, capacity: int = 1024, max_age_ms: int | None = None) -> Consumer:
        self._mode, self._capacity, self._max_age_ms = mode, capacity, max_age_ms
        return self

    def batches(self, files: int = 1, interval_seconds: float = 5.0) -> Consumer:
        """Files of a micro-batch, and the time between the starts of two."""
        self._files, self._interval = files, interval_seconds
        return self

    def handle(self, handler: Callable[[Mapping], object]) -> Consumer:
        return self._with(handler=handler)

    def retry(self, *rules: RetryRule) -> Consumer:
        return self._with(policy=RetryPolicy(rules))

    def on_failure(self, branch: Callable[[Mapping, BaseException], None]) -> Consumer:
        return self._with(on_failure=branch)

    def context(self, wrap: Callable[[Mapping, Callable[[], tuple]], tuple]) -> Consumer:
        return self._with(context=wrap)

    def metrics(self, metrics: Metrics) -> Consumer:
        return self._with(metrics=metrics)

    def _with(self, **change) -> Consumer:
        self._handling = Handling(**({f: getattr(self._handling, f) for f in Handling.__dataclass_fields__} | change))
        return self

    def validate(self) -> Subscription:
        if self._capacity <= 0 or self._files <= 0 or self._interval < 0:
            raise ValueError("capacity, files and interval must be positive")
        if self._max_age_ms is not None and (self._max_age_ms <= 0 or not self._mode.is_freshness_first):
            raise ValueError("max_age_ms is positive and for freshness-first modes only")
        if self._mode.is_freshness_first and ConsumerOptions(self.options).get_bool("enable.auto.commit") is not True:
            raise ValueError(f"enable.auto.commit must be true for {self._mode.name}")
        return Subscription(self._topics, self._pattern, self.options)

    def decide(self, batch: DataFrame, batch_id: int, now_ms: int) -> DataFrame:
        """A micro-batch under the mode: arrival by timestamp, topic, partition and offset within it."""
        rows = batch.withColumns({"window": F.lit(batch_id), "now_ms": F.lit(now_ms), "timestamp_ms": F.col("timestamp")})
        if self._mode.tracks_offsets:
            rows = rows.withColumn("arrival", F.col("offset"))
        else:
            from pyspark.sql import Window

            order = F.row_number().over(Window.partitionBy("window").orderBy("timestamp", "topic", "partition", "offset"))
            rows = rows.withColumn("arrival", order.cast("bigint"))
        return apply_mode(rows, self._mode, ModeOptions(self._capacity, self._max_age_ms))

    def start(self, outcomes: str, checkpoint: str, available_now: bool = False, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)) -> StreamingQuery:
        """Starts the query; outcomes are Parquet files, a folder a batch, written whole or again."""
        subscription = self.validate()
        stream = stream_log(self.spark, self.path, subscription, self._files)

        def batch(frame: DataFrame, batch_id: int) -> None:
            decided = self.decide(frame, batch_id, now_ms()).persist()  # read by each branch of handle
            target = f"{outcomes.rstrip('/')}/batch={batch_id}"
            handle(decided, self._handling, self._mode.tracks_offsets and self._mode is not Mode.AT_LEAST_ONCE_NO_ORDERING).write.mode("overwrite").parquet(target)
            decided.unpersist()
            written = frame.sparkSession.read.parquet(target)
            counts = {r["outcome"]: r["count"] for r in written.groupBy("outcome").count().collect()}
            for k, n in counts.items():
                self.counts[k] = self.counts.get(k, 0) + n
            self._handling.metrics.on_batch(batch_id, counts)

        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self._interval} seconds")
        self.query = writer.start()
        return self.query

    def stop(self, timeout_seconds: float | None = None) -> None:
        """Takes what is there, then stops."""
        if self.query is not None and self.query.isActive:
            try:
                self.query.processAllAvailable()
            finally:
                self.query.stop()

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def state(self) -> dict:
        """What can be told now: mode, outcomes so far, failure, and the last progress."""
        failed = self.query.exception() if self.query is not None else None
        progress = self.query.lastProgress if self.query is not None else None
        return {
            "mode": self._mode.name, "started": self.query is not None, "running": self.running, "failed": failed is not None,
            "failure": str(failed) if failed else None, "counts": dict(self.counts), "capacity": self._capacity,
            "last_batch": progress["batchId"] if progress else None, "last_rows": progress["numInputRows"] if progress else None,
        }


def consumer(spark: SparkSession, path: str, options: Mapping[str, object] | None = None) -> Consumer:
    return Consumer(spark, path, options)


# --- named consumers


@dataclass
class Entry:
    name: str
    start: Callable[[], Consumer]
    auto_startup: bool = True
    consumer: Consumer | None = None


class Registry:
    """Named consumers: started in the order of registration, stopped in reverse."""

    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def register(self, name: str, start: Callable[[], Consumer], auto_startup: bool = True) -> None:
        if not name.strip():
            raise ValueError("a consumer's name may not be blank")
        if name in self.entries:
            raise ValueError(f"consumer {name!r} is registered already")
        self.entries[name] = Entry(name, start, auto_startup)

    def _entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise KeyError(f"no consumer {name!r}")
        return self.entries[name]

    def start(self, name: str | None = None) -> None:
        for e in [self._entry(name)] if name else [e for e in self.entries.values() if e.auto_startup]:
            if not self.is_running(e.name):
                e.consumer = e.start()

    def stop(self, name: str | None = None, timeout_seconds: float = 30.0) -> None:
        """All of them share the time; each is stopped even if another fails, then the first failure is raised."""
        deadline, first = time.monotonic() + timeout_seconds, None
        for e in reversed([self._entry(name)] if name else list(self.entries.values())):
            if e.consumer is not None and e.consumer.running:
                try:
                    e.consumer.stop(max(0.0, deadline - time.monotonic()))
                except Exception as error:
                    first = first or error
        if first is not None:
            raise first

    def is_running(self, name: str) -> bool:
        e = self._entry(name)
        return e.consumer is not None and e.consumer.running

    def states(self, spark: SparkSession) -> DataFrame:
        """name, failed, auto_startup, running, for operators.experiments.health()."""
        rows = [
            (e.name, bool(e.consumer and e.consumer.query is not None and e.consumer.query.exception() is not None), e.auto_startup, self.is_running(e.name))
            for e in self.entries.values()
        ]
        return spark.createDataFrame(rows, "name string, failed boolean, auto_startup boolean, running boolean")


# --- declared configuration


@dataclass(frozen=True)
class ConsumerConfig:
    topics: Sequence[str] | None = None
    topic_pattern: str | None = None
    cluster: str | None = None
    mode: Mode = Mode.AT_LEAST_ONCE_NO_ORDERING
    capacity: int = 1024
    max_age_ms: int | None = None
    retry_schema: str | None = None
    metrics_schema: str | None = None
    auto_startup: bool = True
    options: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Configuration:
    """Clusters, retry schemas and consumers by name, with defaults."""

    consumers: Mapping[str, ConsumerConfig]
    clusters: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    retry_schemas: Mapping[str, Sequence[RetryRule]] = field(default_factory=dict)
    metrics_schemas: Mapping[str, object] = field(default_factory=dict)
    default_cluster: str | None = None
    default_retry_schema: str | None = None
    default_metrics_schema: str | None = None

    def cluster_of(self, name: str) -> str:
        """The consumer's own, else the default, else the only one."""
        found = self.consumers[name].cluster or self.default_cluster or only(self.clusters)
        if found is None:
            raise ValueError(f"no cluster for consumer {name!r}")
        if found not in self.clusters:
            raise ValueError(f"consumer {name!r} names an unknown cluster {found!r}")
        return found

    def options_of(self, name: str) -> dict[str, object]:
        """The cluster's options under the consumer's."""
        return {**self.clusters[self.cluster_of(name)], **self.consumers[name].options}

    def retry_of(self, name: str) -> RetryPolicy:
        schema = self.consumers[name].retry_schema or self.default_retry_schema
        if not schema:
            return RetryPolicy()
        if schema not in self.retry_schemas:
            raise ValueError(f"consumer {name!r} names an unknown retry schema {schema!r}")
        return RetryPolicy(tuple(self.retry_schemas[schema]))

    def metrics_schema_of(self, name: str) -> str | None:
        """The consumer's own, the default, the one called `default`, the only one; None if none is declared."""
        if not self.metrics_schemas:
            return None
        found = self.consumers[name].metrics_schema or self.default_metrics_schema
        found = found or ("default" if "default" in self.metrics_schemas else only(self.metrics_schemas))
        if found is None or found not in self.metrics_schemas:
            raise ValueError(f"no metrics schema for consumer {name!r}")
        return found

    def validate(self, handlers: Sequence[str]) -> None:
        """Handlers and configurations match one to one, and every name that is used is declared."""
        repeated = sorted({h for h in handlers if list(handlers).count(h) > 1})
        if repeated:
            raise ValueError(f"several handlers for {', '.join(repeated)}")
        if missing := sorted(set(handlers) - set(self.consumers)):
            raise ValueError(f"no configuration for {', '.join(missing)}")
        if missing := sorted(set(self.consumers) - set(handlers)):
            raise ValueError(f"no handler for {', '.join(missing)}")
        for name, c in self.consumers.items():
            Subscription(c.topics, c.topic_pattern, c.options)
            self.cluster_of(name), self.retry_of(name), self.metrics_schema_of(name)
            if c.capacity <= 0 or (c.max_age_ms is not None and (c.max_age_ms <= 0 or not c.mode.is_freshness_first)):
                raise ValueError(f"consumer {name!r} has a capacity or an age that its mode doesn't allow")


def only(names: Mapping[str, object]) -> str | None:
    return next(iter(names)) if len(names) == 1 else None


def resolve_for(name: str, named: Sequence[tuple[str | None, object]], use_single: bool = False) -> object | None:
    """What is declared for a consumer: for its name, else for a blank name, else the only undeclared one.

    named: (consumer name, "" for all, or None if it isn't declared for any; the thing).
    """
    for wanted in (name, ""):
        hits = [x for n, x in named if n is not None and n.strip() == wanted]
        if len(hits) > 1:
            raise ValueError(f"several are declared for {wanted or 'all consumers'!r}")
        if hits:
            return hits[0]
    return named[0][1] if use_single and len(named) == 1 else None


#: Modes that other engines' consumers offer. Fixed values.
ENGINE_MODES = {
    "container": (Mode.FRESHNESS_FIRST_DROP_OLDEST, Mode.AT_LEAST_ONCE_PARTITION_ORDERING),
    "thread_pool": (Mode.AT_LEAST_ONCE_NO_ORDERING, Mode.FRESHNESS_FIRST_DROP_OLDEST),
    "parallel": (Mode.AT_LEAST_ONCE_NO_ORDERING, Mode.FRESHNESS_FIRST_DROP_OLDEST, Mode.AT_LEAST_ONCE_KEY_ORDERING, Mode.AT_LEAST_ONCE_PARTITION_ORDERING),
}


def require_supported(engine: str, mode: Mode) -> Mode:
    if mode not in ENGINE_MODES[engine]:
        raise ValueError(f"{mode.name} is not supported by the {engine} consumer")
    return mode
