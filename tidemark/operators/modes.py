"""The five processing contracts as functions from records to decided records.

Records have topic, partition, offset, key, timestamp_ms and `arrival` (bigint, unique, the order in
which a poller takes them). Each function adds

    lane     records of one lane are processed one after the other; null where there is no order
    seq      a record's place in its lane, from 0; null without a lane
    outcome  processed or dropped
    reason   why it was dropped: already_processed, queue_overflow, replaced_by_newer_key_record,
             new_key_queue_full, stale_age or admission_failed

Freshness modes depend on when a queue drains. A drain window is a column of the records (`window`): what
one window holds is queued together, then drained. Records of the boolean column `in_flight`, if there
is one, are with a worker already: they are processed and take no place in the queue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scans import numbered

DECIDED = ["lane", "seq", "outcome", "reason"]
NULL_LANE = "null"


class Mode(Enum):
    """The contracts, by the names that configurations use."""

    AT_LEAST_ONCE_NO_ORDERING = "unordered"
    AT_LEAST_ONCE_KEY_ORDERING = "key"
    AT_LEAST_ONCE_PARTITION_ORDERING = "partition"
    FRESHNESS_FIRST_DROP_OLDEST = "drop_oldest"
    FRESHNESS_FIRST_REPLACE_PENDING_BY_KEY = "replace_pending"

    @property
    def tracks_offsets(self) -> bool:
        return not self.is_freshness_first

    @property
    def is_freshness_first(self) -> bool:
        return self in (Mode.FRESHNESS_FIRST_DROP_OLDEST, Mode.FRESHNESS_FIRST_REPLACE_PENDING_BY_KEY)


def key_lane(key: Column | str = "key") -> Column:
    """Lane of a key; null keys share one."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.concat(F.lit("k:"), key.cast("string")), F.lit(NULL_LANE))


def partition_lane() -> Column:
    return F.concat(F.lit("p:"), F.col("topic"), F.lit("/"), F.col("partition").cast("string"))


def span(c: str, size: int) -> Column:
    """Chunk of a bigint column for scans.prefix()."""
    return F.expr(f"{c} div {size}")


def is_stale(now_ms: Column | str, max_age_ms: int | None) -> Column:
    """Older than max_age_ms; never where the timestamp is not positive; equal age is kept."""
    if max_age_ms is None:
        return F.lit(False)
    if max_age_ms < 0:
        raise ValueError("max_age_ms may not be negative")
    now = F.col(now_ms) if isinstance(now_ms, str) else now_ms
    return F.coalesce((F.col("timestamp_ms") > 0) & (now - F.col("timestamp_ms") > max_age_ms), F.lit(False))


def _decide(rows: DataFrame, columns: list[str], reason: Column, lane: Column | None = None, seq: Column | None = None) -> DataFrame:
    return rows.select(
        *columns,
        (lane if lane is not None else F.lit(None).cast("string")).alias("lane"),
        (seq if seq is not None else F.lit(None).cast("bigint")).alias("seq"),
        F.when(reason.isNull(), "processed").otherwise("dropped").alias("outcome"),
        reason.alias("reason"),
    )


def _no_reason() -> Column:
    return F.lit(None).cast("string")


def unordered(records: DataFrame) -> DataFrame:
    """At least once without order: back-pressure holds records up, none is dropped."""
    return _decide(records, records.columns, _no_reason())


def key_ordering(records: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """At least once, one record of a key in flight: a key's records in arrival order.

    A key that very many records share is cut into chunks of arrival for numbering.
    """
    rows = numbered(records.withColumn("_lane", key_lane()), "_seq", ["_lane"], ["arrival"], span("arrival", chunk))
    return _decide(rows, records.columns, _no_reason(), F.col("_lane"), F.col("_seq"))


def partition_ordering(records: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """At least once, a partition's records in the order of their offsets."""
    rows = numbered(records.withColumn("_lane", partition_lane()), "_seq", ["_lane"], ["offset"], span("offset", chunk))
    return _decide(rows, records.columns, _no_reason(), F.col("_lane"), F.col("_seq"))


def _queued(records: DataFrame) -> Column:
    return ~F.coalesce(F.col("in_flight"), F.lit(False)) if "in_flight" in records.columns else F.lit(True)


def _cut(queued: DataFrame, capacity: int, newest: bool) -> DataFrame:
    """window, _cut: the arrival of the last of `capacity` records admitted, newest or oldest first.

    Row number with a bound above it is a top-n in Spark's plan: each task keeps `capacity` rows a
    window before anything is shuffled.
    """
    order = F.desc("arrival") if newest else F.asc("arrival")
    place = F.row_number().over(Window.partitionBy("window").orderBy(order))
    top = queued.select("window", "arrival").withColumn("_n", place).where(F.col("_n") <= capacity)
    return top.groupBy("window").agg((F.min("arrival") if newest else F.max("arrival")).alias("_cut"))


def drop_oldest(records: DataFrame, capacity: int, now_ms: Column | str = "now_ms", max_age_ms: int | None = None) -> DataFrame:
    """Freshness first: a full queue gives up its oldest. Stale records occupy a place until drained."""
    _positive(capacity)
    queued = _queued(records)
    rows = records.join(_cut(records.where(queued), capacity, True), "window", "left")
    reason = F.when(queued & (F.col("arrival") < F.col("_cut")), "queue_overflow").when(is_stale(now_ms, max_age_ms), "stale_age")
    return _decide(rows, records.columns, reason)


def replace_pending(records: DataFrame, capacity: int, now_ms: Column | str = "now_ms", max_age_ms: int | None = None) -> DataFrame:
    """Freshness first: one queued record a key, the newest; capacity counts keys, further keys are dropped.

    Keys are admitted by first arrival in the window. Per (window, key) only the first and last arrival
    are kept, combined before the shuffle.
    """
    _positive(capacity)
    rows = records.withColumn("_lane", key_lane())
    queued = _queued(records)
    keys = rows.where(queued).groupBy("window", "_lane").agg(F.min("arrival").alias("arrival"), F.max("arrival").alias("_last"))
    cut = _cut(keys, capacity, False)
    keys = keys.join(cut, "window").select("window", "_lane", "_last", (F.col("arrival") <= F.col("_cut")).alias("_admitted"))
    rows = rows.join(keys, ["window", "_lane"], "left")
    reason = (
        F.when(queued & ~F.col("_admitted"), "new_key_queue_full")
        .when(queued & (F.col("arrival") < F.col("_last")), "replaced_by_newer_key_record")
        .when(is_stale(now_ms, max_age_ms), "stale_age")
    )
    return _decide(rows, records.columns, reason, F.col("_lane"))


def bounded_pool(records: DataFrame, capacity: int, workers: int = 0) -> DataFrame:
    """A worker pool with a full queue rejects what comes: the first `workers + capacity` of a window stay.

    The metric's reason is queue_overflow, the audit's admission_failed; this gives the latter.
    """
    _positive(capacity)
    rows = records.join(_cut(records.where(_queued(records)), capacity + workers, False), "window", "left")
    return _decide(rows, records.columns, F.when(_queued(records) & (F.col("arrival") > F.col("_cut")), "admission_failed"))


def stale_filter(records: DataFrame, now_ms: Column | str, max_age_ms: int | None, mode: Mode | None = None) -> DataFrame:
    """Only the age rule; with a mode it holds for freshness modes alone."""
    on = mode is None or mode.is_freshness_first
    return _decide(records, records.columns, F.when(is_stale(now_ms, max_age_ms if on else None), "stale_age"))


def skip_processed(records: DataFrame, processed: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """decide() for what was not processed before; the rest is dropped as already_processed.

    processed: topic, partition, offset, of any size and order.
    """
    known = ["topic", "partition", "offset"]
    done = processed.select(*known).distinct().withColumn("_done", F.lit(True))
    marked = records.join(done, known, "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    todo = decide(marked.where(~F.col("_done")).select(*records.columns))
    again = _decide(marked.where("_done"), records.columns, F.lit("already_processed"))
    return todo.select(*records.columns, *DECIDED).unionByName(again)


def handled(decided: DataFrame, value: str = "value") -> DataFrame:
    """What a handler gets: processed records with a value. A null value completes without being handled."""
    return decided.where((F.col("outcome") == "processed") & F.col(value).isNotNull())


def _positive(capacity: int) -> None:
    if capacity <= 0:
        raise ValueError("capacity must be positive")


@dataclass(frozen=True)
class ModeOptions:
    capacity: int = 1024
    max_age_ms: int | None = None
    now_ms: str = "now_ms"


def apply_mode(records: DataFrame, mode: Mode, options: ModeOptions | None = None) -> DataFrame:
    """The function of a mode."""
    o = options or ModeOptions()
    if o.max_age_ms is not None and not mode.is_freshness_first:
        raise ValueError("max_age_ms is for freshness-first modes only")
    if mode is Mode.AT_LEAST_ONCE_NO_ORDERING:
        return unordered(records)
    if mode is Mode.AT_LEAST_ONCE_KEY_ORDERING:
        return key_ordering(records)
    if mode is Mode.AT_LEAST_ONCE_PARTITION_ORDERING:
        return partition_ordering(records)
    if mode is Mode.FRESHNESS_FIRST_DROP_OLDEST:
        return drop_oldest(records, o.capacity, o.now_ms, o.max_age_ms)
    return replace_pending(records, o.capacity, o.now_ms, o.max_age_ms)


def queue_high_water(steps: DataFrame, group: list[str], order: list[str], delta: str, chunk: Column | None = None) -> DataFrame:
    """group, high_water, size: the most that a queue held, and what it holds at the end.

    steps: +1 where a record is queued, -1 where one leaves; a size never falls below 0 as long as no
    record leaves before it came.
    """
    from tidemark.functions.scans import prefix

    rows = prefix(steps, "_before", F.col(delta).cast("bigint"), group, order, "sum", chunk)
    now = F.coalesce("_before", F.lit(0)) + F.col(delta)
    return rows.groupBy(*group).agg(
        F.greatest(F.max(now), F.lit(0)).cast("bigint").alias("high_water"), F.sum(delta).cast("bigint").alias("size")
    )
