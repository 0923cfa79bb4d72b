"""Offsets and processing modes over the derived record log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import modes, offsets
from tidemark.sources import derived

from .common import RECORDS, plain

CAPACITY = 64
MAX_AGE_MS = 3_600_000
PAIR = '"partition", "offset"'


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.records(derived.events(spark, sf_dir))


def _progress(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Completions out of order, and bases: partition 3 starts at 9 instead of the beginning."""
    log = derived.log(derived.events(spark, sf_dir)).withColumn("topic", F.concat(F.lit("topic-"), F.col("topic_id").cast("string")))
    done = log.where((F.col("event_type") != "signup") | (F.col("offset") < 40 * (F.col("partition") + 1))).select("topic", "partition", "offset")
    bases = log.select("topic", "partition").distinct().withColumn("base", F.when(F.col("partition") == 3, 9).otherwise(-1).cast("bigint"))
    return done, bases


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.frontier(*_progress(spark, sf_dir))


def commit_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_frontier(spark, sf_dir))


def pending_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(offsets.pending(_frontier(spark, sf_dir)))


def commit_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(offsets.commit_data(_frontier(spark, sf_dir)))


def tracker_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(offsets.tracker_capacity(_frontier(spark, sf_dir)))


def completion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(offsets.runs(*_progress(spark, sf_dir)))


def remainder_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(offsets.remainder_runs(*_progress(spark, sf_dir)))


def restart_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer restarted from the frontier and the completions beyond it has still to process."""
    done, bases = _progress(spark, sf_dir)
    records = _records(spark, sf_dir).select("topic", "partition", "offset", "arrival")
    return plain(offsets.restart_skip(records, offsets.frontier(done, bases), done))


def processed_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, bases = _progress(spark, sf_dir)
    asked = _records(spark, sf_dir).select("topic", "partition", "offset")
    return plain(offsets.is_processed(asked, offsets.frontier(done, bases), done))


def _decided(decided: DataFrame) -> DataFrame:
    return plain(decided.select("arrival", "topic", "partition", "offset", *modes.DECIDED))


def mode_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.unordered(_records(spark, sf_dir)))


def mode_key_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.key_ordering(_records(spark, sf_dir)))


def mode_partition_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.partition_ordering(_records(spark, sf_dir)))


def mode_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.drop_oldest(_records(spark, sf_dir), CAPACITY, max_age_ms=MAX_AGE_MS))


def mode_replace_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.replace_pending(_records(spark, sf_dir), CAPACITY, max_age_ms=24 * MAX_AGE_MS))


def mode_bounded_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.bounded_pool(_records(spark, sf_dir), CAPACITY, workers=8))


def stale_age_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(modes.stale_filter(_records(spark, sf_dir), "now_ms", MAX_AGE_MS, modes.Mode.FRESHNESS_FIRST_DROP_OLDEST))


def skip_already_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    before = records.where("arrival % 3 = 0").select("topic", "partition", "offset")
    return _decided(modes.skip_processed(records, before, modes.unordered))


def handled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that reach a handler, of all that complete, by topic: tombstones complete unhandled."""
    decided = modes.unordered(_records(spark, sf_dir))
    done = decided.groupBy("topic").agg(F.count("*").alias("completed"))
    reached = modes.handled(decided).groupBy("topic").agg(F.count("*").alias("handled"))
    return plain(done.join(reached, "topic", "left"))


def queue_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued when it comes, gone after its delay: the most that a partition's queue held."""
    records = _records(spark, sf_dir)
    step = F.explode(
        F.array(
            F.struct(F.col("timestamp_ms").alias("at"), F.lit(1).alias("delta"), F.lit(0).alias("side")),
            F.struct((F.col("timestamp_ms") + F.col("delay_ms") * 100).alias("at"), F.lit(-1).alias("delta"), F.lit(1).alias("side")),
        )
    ).alias("s")
    steps = records.select("topic", "partition", "arrival", step).select("topic", "partition", "s.at", "s.side", "arrival", "s.delta")
    return plain(modes.queue_high_water(steps, ["topic", "partition"], ["at", "side", "arrival"], "delta", F.expr("at div 3600000")))


_PROGRESS = (
    RECORDS
    + """,
done AS (SELECT topic, "partition", "offset" FROM (SELECT r.*, l.event_type AS kind FROM rec r JOIN log l ON l.event_id = r.arrival) WHERE kind <> 'signup' OR "offset" < 40 * ("partition" + 1)),
bases AS (SELECT DISTINCT topic, "partition", CASE WHEN "partition" = 3 THEN 9 ELSE -1 END AS base FROM rec),
ahead AS (SELECT DISTINCT topic, "partition", base, "offset" FROM done JOIN bases USING (topic, "partition") WHERE "offset" > base),
placed AS (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS island FROM ahead),
front AS (
  SELECT topic, "partition", b.base, coalesce(max(p."offset") FILTER (island = b.base), b.base) AS frontier, count(p."offset") AS processed,
    coalesce(max(p."offset"), b.base) AS highest
  FROM bases b LEFT JOIN placed p USING (topic, "partition") GROUP BY topic, "partition", b.base
),
runs AS (SELECT topic, "partition", min("offset") AS start, count(*) AS length FROM placed GROUP BY topic, "partition", island)"""
)

_CAPACITY_SQL = f"""
WITH {_PROGRESS}, live AS (SELECT topic, "partition", greatest(highest - (base + (frontier - base) // 64 * 64 + 1) + 1, 0) AS live_span FROM front)
SELECT topic, "partition", live_span::BIGINT AS live_span,
  greatest(128, 64 * (2 ** ceil(log2(ceil(greatest(live_span, 1) / 64.0))))::BIGINT)::BIGINT AS bit_capacity
FROM live
"""


def _mode_sql(reason: str, lane: str = "NULL::VARCHAR", seq: str = "NULL::BIGINT", source: str = "rec", more: str = "") -> str:
    return f"""
WITH {RECORDS}{more}
SELECT arrival, topic, "partition"::BIGINT AS "partition", "offset"::BIGINT AS "offset", {lane} AS lane, {seq} AS seq,
  CASE WHEN reason IS NULL THEN 'processed' ELSE 'dropped' END AS outcome, reason::VARCHAR AS reason
FROM (SELECT *, {reason} AS reason FROM {source})
"""


_RANKED = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY arrival DESC) AS newest, row_number() OVER (PARTITION BY win ORDER BY arrival) AS oldest FROM rec)"""
_BY_KEY = """,
firsts AS (SELECT *, min(arrival) OVER (PARTITION BY win, lane) AS came, max(arrival) OVER (PARTITION BY win, lane) AS latest FROM rec),
admitted AS (SELECT *, dense_rank() OVER (PARTITION BY win ORDER BY came) AS place FROM firsts)"""
_PART_LANE = "'p:' || topic || '/' || \"partition\""

WATER_SQL = f"""
WITH {RECORDS},
steps AS (
  SELECT topic, "partition", timestamp_ms AS moment, 0 AS side, arrival, 1 AS delta FROM rec
  UNION ALL SELECT topic, "partition", timestamp_ms + delay * 100, 1, arrival, -1 FROM rec
),
sized AS (SELECT *, sum(delta) OVER (PARTITION BY topic, "partition" ORDER BY moment, side, arrival) AS size FROM steps)
SELECT topic, "partition"::BIGINT AS "partition", greatest(max(size), 0)::BIGINT AS high_water, sum(delta)::BIGINT AS size FROM sized GROUP BY 1, 2
"""

QUERIES = {
    "commit_frontier": (
        commit_frontier,
        f'WITH {_PROGRESS} SELECT topic, "partition"::BIGINT AS "partition", base::BIGINT AS base, frontier::BIGINT AS frontier, processed, highest::BIGINT AS highest FROM front',
    ),
    "pending_offsets": (pending_offsets, f"WITH {_PROGRESS} SELECT least(sum(frontier - base), 2147483647)::BIGINT AS pending_offsets FROM front"),
    "commit_data": (
        commit_data,
        f'WITH {_PROGRESS} SELECT topic, "partition"::BIGINT AS "partition", (frontier + 1)::BIGINT AS commit_offset, (frontier - base)::BIGINT AS advanced, '
        "(processed - (frontier - base))::BIGINT AS remainder FROM front WHERE frontier > base",
    ),
    "tracker_capacity": (tracker_capacity, _CAPACITY_SQL.replace('SELECT topic, "partition", live_span::', 'SELECT topic, "partition"::BIGINT AS "partition", live_span::')),
    "completion_runs": (completion_runs, f'WITH {_PROGRESS} SELECT topic, "partition"::BIGINT AS "partition", start::BIGINT AS start, length FROM runs'),
    "remainder_runs": (
        remainder_runs,
        f'WITH {_PROGRESS} SELECT topic, "partition"::BIGINT AS "partition", start::BIGINT AS start, length FROM runs JOIN bases USING (topic, "partition") WHERE start <> base + 1',
    ),
    "restart_skip": (
        restart_skip,
        f'WITH {_PROGRESS} SELECT topic, "partition"::BIGINT AS "partition", "offset"::BIGINT AS "offset", arrival FROM rec JOIN front USING (topic, "partition") '
        'WHERE "offset" > frontier AND (topic, "partition", "offset") NOT IN (SELECT (topic, "partition", "offset") FROM done)',
    ),
    "processed_membership": (
        processed_membership,
        f'WITH {_PROGRESS} SELECT topic, "partition"::BIGINT AS "partition", "offset"::BIGINT AS "offset", '
        '"offset" <= frontier OR (topic, "partition", "offset") IN (SELECT (topic, "partition", "offset") FROM done) AS already_processed '
        'FROM rec JOIN front USING (topic, "partition")',
    ),
    "mode_unordered": (mode_unordered, _mode_sql("NULL")),
    "mode_key_ordering": (mode_key_ordering, _mode_sql("NULL", "lane", "(row_number() OVER (PARTITION BY lane ORDER BY arrival) - 1)::BIGINT")),
    "mode_partition_ordering": (
        mode_partition_ordering,
        _mode_sql("NULL", _PART_LANE, '(row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1)::BIGINT'),
    ),
    "mode_drop_oldest": (
        mode_drop_oldest,
        _mode_sql(
            f"CASE WHEN newest > {CAPACITY} THEN 'queue_overflow' WHEN timestamp_ms > 0 AND now_ms - timestamp_ms > {MAX_AGE_MS} THEN 'stale_age' END",
            source="ranked", more=_RANKED,
        ),
    ),
    "mode_replace_pending": (
        mode_replace_pending,
        _mode_sql(
            f"CASE WHEN place > {CAPACITY} THEN 'new_key_queue_full' WHEN arrival < latest THEN 'replaced_by_newer_key_record' "
            f"WHEN timestamp_ms > 0 AND now_ms - timestamp_ms > {24 * MAX_AGE_MS} THEN 'stale_age' END",
            "lane", source="admitted", more=_BY_KEY,
        ),
    ),
    "mode_bounded_pool": (
        mode_bounded_pool,
        _mode_sql(f"CASE WHEN oldest > {CAPACITY + 8} THEN 'admission_failed' END", source="ranked", more=_RANKED),
    ),
    "stale_age_drop": (stale_age_drop, _mode_sql(f"CASE WHEN timestamp_ms > 0 AND now_ms - timestamp_ms > {MAX_AGE_MS} THEN 'stale_age' END")),
    "skip_already_processed": (skip_already_processed, _mode_sql("CASE WHEN arrival % 3 = 0 THEN 'already_processed' END")),
    "handled_values": (handled_values, f"WITH {RECORDS} SELECT topic, count(*) AS completed, count(val) AS handled FROM rec GROUP BY topic"),
    "queue_high_water": (queue_high_water, WATER_SQL),
}
