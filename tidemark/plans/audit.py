"""Delivery audit over the derived audit log."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import topic_name_of
from tidemark.functions.stats import SUMMARY, distribution
from tidemark.operators import audit
from tidemark.schemas import LATENCY_RULE
from tidemark.sinks.audit import encode
from tidemark.sources.audit import parse
from tidemark.sources.derived import arrival_chunk, audit_records, events

from .common import AUDIT, LIFE, plain

RULES = [
    ("business", "Business events", ["order.events.v1", "batch.events.v1"], [1, 2], 2000, Decimal("40.5")),
    ("telemetry", "Telemetry", ["cauldron.events.v1"], [3], 1000, Decimal(5)),
]
TTL_MS = 60_000


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_records(events(spark, sf_dir))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lifecycle(_records(spark, sf_dir))


def delivery_audit_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit.named(audit.audit_counts(_records(spark, sf_dir)))
    return plain(counts.select("topic", *audit.COUNTS))


def bounded_ttl_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    keys = audit.bounded_lifecycle(records, TTL_MS, arrival_chunk())
    wanted = ["published", "processed", "failed", "dropped", "missing_terminal", "processed_without_publish", "failed_without_publish", "dropped_without_publish"]
    return plain(audit.named(audit.audit_counts(records, keys)).select("topic", *wanted))


def audit_line_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _records(spark, sf_dir).select(encode().alias("value"), "arrival")
    back = parse(lines.unionByName(lines.limit(1).withColumn("value", F.lit("S|shutdown|drain|1"))))
    return plain(back.select(encode().alias("line"), *(c for c in back.columns if c != "arrival")))


def drops_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.named(audit.drops_by_reason(_keys(spark, sf_dir))).select("topic", "reason", "drops"))


def retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("record_type = 'R'").groupBy("topic_id").agg(F.count("*").alias("retry_attempts"))
    return plain(rows)


def _ordering(group):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = audit.ordering_counts(_keys(spark, sf_dir), group, arrival_chunk())
        return plain(audit.named(counts).select("topic", "out_of_order", "processed", "failed"))

    return query


def ordering_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.out_of_order(audit.ordering_input(_keys(spark, sf_dir)), audit.BY_PARTITION, arrival_chunk()))


def latency_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, LATENCY_RULE)
    out = audit.latency_sla(_keys(spark, sf_dir), rules)
    topic = F.when(F.col("topic_id").isNull(), F.lit("all")).otherwise(topic_name_of("topic_id"))
    return plain(out.select("id", topic.alias("topic"), *out.columns[4:]))


def record_age_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.record_age(_keys(spark, sf_dir)))


def key_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.key_outcomes(_keys(spark, sf_dir)))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return audit.processed_gaps(audit.lifecycle(records), audit.watermark(records), chunk=arrival_chunk())


def key_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.key_fairness(audit.key_outcomes(_keys(spark, sf_dir)), _gaps(spark, sf_dir)))


def processed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_gaps(spark, sf_dir))


def gap_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.gap_thresholds(_gaps(spark, sf_dir)))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.drop_islands(_keys(spark, sf_dir), chunk=arrival_chunk())


def freshness_gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.freshness_histogram(_islands(spark, sf_dir)))


def freshness_gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(distribution(_islands(spark, sf_dir).where("processed_ms is not null"), "dropped"))


def pending_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.freshness_summary(_islands(spark, sf_dir)))


def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(distribution(events(spark, sf_dir).select("event_type", "value"), "value", ["event_type"]))


_NAMED = "CASE WHEN grouping(topic_id) = 1 THEN 'all' WHEN topic_id = 1 THEN 'order.events.v1' WHEN topic_id = 2 THEN 'batch.events.v1' ELSE 'cauldron.events.v1' END AS topic"
_SETS = "GROUP BY GROUPING SETS ((), (topic_id)) HAVING grouping(topic_id) = 1 OR topic_id IN (1, 2, 3)"

DELIVERY_SQL = f"""
WITH {LIFE},
ends AS (SELECT topic_id, part, off, max(n) AS n, max(k) AS k FROM opened GROUP BY ALL),
life AS (
  SELECT f.*, coalesce(e.n, 0) AS n, coalesce(e.k, 0) AS k FROM firsts f LEFT JOIN ends e USING (topic_id, part, off)
),
matched AS (
  SELECT {_NAMED},
    sum((n_p > 0)::INT) AS published, sum((n_c > 0)::INT) AS processed, sum((n_f > 0)::INT) AS failed, sum((n_d > 0)::INT) AS dropped,
    sum((n > 0)::INT) AS terminal, sum((n_p > 0 AND n = 0)::INT) AS missing_terminal,
    sum(greatest(n_p - 1, 0)) AS duplicate_published, sum(greatest(n_c - 1, 0)) AS duplicate_processed,
    sum(greatest(n_f - 1, 0)) AS duplicate_failed, sum(greatest(n_d - 1, 0)) AS duplicate_dropped,
    sum((n_p = 0 AND n_c > 0)::INT) AS processed_without_publish, sum((n_p = 0 AND n_f > 0)::INT) AS failed_without_publish,
    sum((n_p = 0 AND n_d > 0)::INT) AS dropped_without_publish, sum((k >= 2)::INT + n - k) AS conflicting_terminal_outcomes
  FROM life {_SETS}
),
raw AS (SELECT {_NAMED}, count(*) AS records_read, count(*) FILTER (t = 'R') AS retry_attempts FROM aud {_SETS})
SELECT m.topic, r.records_read::BIGINT AS records_read, m.published::BIGINT AS published, m.processed::BIGINT AS processed, m.failed::BIGINT AS failed,
  m.dropped::BIGINT AS dropped, m.terminal::BIGINT AS terminal, m.missing_terminal::BIGINT AS missing_terminal, r.retry_attempts::BIGINT AS retry_attempts,
  m.duplicate_published::BIGINT AS duplicate_published, m.duplicate_processed::BIGINT AS duplicate_processed, m.duplicate_failed::BIGINT AS duplicate_failed,
  m.duplicate_dropped::BIGINT AS duplicate_dropped, m.processed_without_publish::BIGINT AS processed_without_publish,
  m.failed_without_publish::BIGINT AS failed_without_publish, m.dropped_without_publish::BIGINT AS dropped_without_publish,
  m.conflicting_terminal_outcomes::BIGINT AS conflicting_terminal_outcomes
FROM matched m JOIN raw r USING (topic)
"""

TTL_SQL = f"""
WITH {AUDIT},
timed AS (SELECT *, max(seen) OVER (PARTITION BY topic_id ORDER BY a) AS now_ms FROM aud),
touched AS (
  SELECT *, lag(seen) OVER (PARTITION BY topic_id, part, off ORDER BY a) AS before
  FROM timed WHERE part >= 0 AND off >= 0 AND t <> 'R'
),
sessions AS (
  SELECT *, sum((coalesce(now_ms - {TTL_MS} > before, false))::INT) OVER (PARTITION BY topic_id, part, off ORDER BY a) AS s FROM touched
),
life AS (
  SELECT topic_id, part, off, s, count(*) FILTER (t = 'P') AS n_p, count(*) FILTER (t = 'C') AS n_c, count(*) FILTER (t = 'F') AS n_f, count(*) FILTER (t = 'D') AS n_d
  FROM sessions GROUP BY ALL
)
SELECT {_NAMED},
  sum((n_p > 0)::INT)::BIGINT AS published, sum((n_c > 0)::INT)::BIGINT AS processed, sum((n_f > 0)::INT)::BIGINT AS failed, sum((n_d > 0)::INT)::BIGINT AS dropped,
  sum((n_p > 0 AND n_c + n_f + n_d = 0)::INT)::BIGINT AS missing_terminal,
  sum((n_p = 0 AND n_c > 0)::INT)::BIGINT AS processed_without_publish, sum((n_p = 0 AND n_f > 0)::INT)::BIGINT AS failed_without_publish,
  sum((n_p = 0 AND n_d > 0)::INT)::BIGINT AS dropped_without_publish
FROM life {_SETS}
"""

ROUNDTRIP_SQL = f"""
WITH {AUDIT}
SELECT concat_ws('|', t, topic_id, part, off, CASE WHEN t = 'P' THEN kafka END, seen, message_key, why) AS line, t AS record_type, topic_id::BIGINT AS topic_id,
  part::BIGINT AS "partition", off::BIGINT AS "offset", kafka AS kafka_ts_ms, seen AS audit_ts_ms, message_key, why AS drop_reason
FROM aud
"""

DROPS_SQL = f"""
WITH {LIFE}, drops AS (SELECT topic_id, coalesce(why, 'unknown') AS reason FROM opened WHERE t = 'D')
SELECT {_NAMED}, reason, count(*) AS drops FROM drops
GROUP BY GROUPING SETS ((reason), (topic_id, reason)) HAVING grouping(topic_id) = 1 OR topic_id IN (1, 2, 3)
"""

RETRY_SQL = f"WITH {AUDIT} SELECT topic_id::BIGINT AS topic_id, count(*) AS retry_attempts FROM aud WHERE t = 'R' GROUP BY 1"


def _ordering_sql(group: str) -> str:
    return f"""
WITH {LIFE}, first AS (SELECT topic_id, part, off, t, a, message_key FROM opened WHERE place = 1 AND t IN ('C', 'F')),
late AS (
  SELECT topic_id, part, t, coalesce(off < max(off) OVER (PARTITION BY {group} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS l FROM first
)"""


ORDER_TAIL = f"""
SELECT {_NAMED}, sum(l::INT)::BIGINT AS out_of_order, sum((l AND t = 'C')::INT)::BIGINT AS processed, sum((l AND t = 'F')::INT)::BIGINT AS failed
FROM late {_SETS}
"""

GROUPS_TAIL = """
SELECT topic_id::BIGINT AS topic_id, part::BIGINT AS "partition", sum(l::INT)::BIGINT AS out_of_order, sum((l AND t = 'C')::INT)::BIGINT AS processed,
  sum((l AND t = 'F')::INT)::BIGINT AS failed
FROM late GROUP BY 1, 2
"""

SLA_SQL = f"""
WITH {LIFE},
rules AS (
  SELECT * FROM (VALUES ('business', 1, 2000, 40.5), ('business', 2, 2000, 40.5), ('telemetry', 3, 1000, 5.0)) v(id, topic_id, max_ms, allowed)
),
done AS (SELECT r.*, seen - kafka AS ms FROM opened JOIN rules r USING (topic_id) WHERE t = 'C' AND is_open),
scopes AS (SELECT id, topic_id, max_ms, allowed FROM rules UNION ALL SELECT DISTINCT id, NULL, max_ms, allowed FROM rules),
counted AS (
  SELECT s.id, s.topic_id, any_value(s.max_ms) AS max_ms, any_value(s.allowed) AS allowed, count(d.id) AS processed, count(*) FILTER (ms >= 0) AS measured,
    count(*) FILTER (ms > s.max_ms) AS exceeded, count(*) FILTER (ms < 0) AS negative, max(ms) FILTER (ms >= 0) AS longest
  FROM scopes s LEFT JOIN done d ON d.id = s.id AND (s.topic_id IS NULL OR s.topic_id = d.topic_id) GROUP BY s.id, s.topic_id
)
SELECT id, CASE topic_id WHEN 1 THEN 'order.events.v1' WHEN 2 THEN 'batch.events.v1' WHEN 3 THEN 'cauldron.events.v1' ELSE 'all' END AS topic,
  max_ms::BIGINT AS max_ms, allowed::DOUBLE AS allowed_exceed_percent, processed, measured, processed - measured AS unmeasured,
  measured - exceeded AS within_sla, exceeded, CASE WHEN measured > 0 THEN round(100 * exceeded / measured, 6) END AS exceeded_percent,
  longest AS max_observed_ms, negative AS invalid_negative_latency,
  CASE WHEN processed = 0 THEN 'NOT_EVALUATED' WHEN processed > measured THEN 'INCOMPLETE' WHEN 100 * exceeded <= measured * allowed THEN 'PASS' ELSE 'FAIL' END AS status
FROM counted
"""

AGE_SQL = f"""
WITH {LIFE},
closing AS (
  SELECT topic_id, part, off, any_value(kafka) AS kafka, coalesce(max(CASE WHEN t = 'C' THEN 'processed' END), max(CASE WHEN t = 'F' THEN 'failed' END), 'dropped') AS outcome,
    coalesce(max(CASE WHEN t = 'C' THEN seen END), max(CASE WHEN t = 'F' THEN seen END), max(seen)) AS seen
  FROM opened WHERE topic_id = 3 AND is_open AND a_p IS NOT NULL GROUP BY ALL
)
SELECT outcome, count(*) AS count, round(avg(greatest(seen - kafka, 0)), 3) AS avg_ms, min(greatest(seen - kafka, 0)) AS min_ms, max(greatest(seen - kafka, 0)) AS max_ms
FROM closing GROUP BY outcome
"""

_OUTCOMES = """
per_key AS (
  SELECT message_key, sum((t = 'P')::INT)::BIGINT AS published, sum((t = 'C')::INT)::BIGINT AS processed, sum((t = 'F')::INT)::BIGINT AS failed, sum((t = 'D')::INT)::BIGINT AS dropped
  FROM (
    SELECT t, message_key FROM opened WHERE topic_id = 3 AND is_open
    UNION ALL SELECT 'P', r.message_key FROM firsts f JOIN aud r ON r.a = f.a_p WHERE f.topic_id = 3
  ) GROUP BY message_key
)"""

_GAPS = """
mark AS (SELECT max(seen) AS w FROM aud WHERE topic_id = 3),
steps AS (SELECT message_key, seen, seen - lag(seen) OVER (PARTITION BY message_key ORDER BY a) AS gap, a FROM opened WHERE topic_id = 3 AND is_open AND t = 'C'),
gaps AS (
  SELECT message_key, CASE WHEN max(gap) > any_value(w) - arg_max(seen, a) THEN max(gap) ELSE any_value(w) - arg_max(seen, a) END AS max_gap_ms
  FROM steps, mark GROUP BY message_key
)"""


def _spread_sql(source: str, group: str) -> str:
    """SUMMARY of source(group, v) by the definitions."""
    return f"""
, ranked AS (SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY v) AS i FROM ({source}))
SELECT {group}, count(*) AS count, round(avg(v), 6) AS avg, round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
  round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max, CASE WHEN avg(v) <> 0 THEN round(stddev_pop(v) / avg(v), 6) END AS coefficient_of_variation,
  CASE WHEN sum(v) <> 0 THEN round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) END AS gini,
  CASE WHEN min(v) <> 0 THEN round(max(v) / min(v), 6) END AS max_to_min
FROM ranked GROUP BY {group}
"""


FAIRNESS_SQL = f"WITH {LIFE}, {_OUTCOMES}, {_GAPS}" + _spread_sql(
    """
  SELECT 'published_per_key' AS metric, published::DOUBLE AS v FROM per_key
  UNION ALL SELECT 'processed_per_key', processed FROM per_key
  UNION ALL SELECT 'dropped_per_key', dropped FROM per_key
  UNION ALL SELECT 'processed_ratio', CASE WHEN published = 0 THEN 0.0 ELSE processed::DOUBLE / published END FROM per_key
  UNION ALL SELECT 'dropped_ratio', CASE WHEN published = 0 THEN 0.0 ELSE dropped::DOUBLE / published END FROM per_key
  UNION ALL SELECT 'processed_max_gap_ms', max_gap_ms FROM gaps""",
    "metric",
)

_ISLANDS = """
marked AS (
  SELECT message_key, t, seen, a, coalesce(sum((t = 'C')::INT) OVER (PARTITION BY message_key ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM opened WHERE topic_id = 3 AND is_open AND t IN ('C', 'D')
),
islands AS (
  SELECT message_key, island, count(*) FILTER (t = 'D') AS dropped, arg_min(seen, a) FILTER (t = 'D') AS first_ms, arg_max(seen, a) FILTER (t = 'D') AS last_ms,
    max(seen) FILTER (t = 'C') AS done_ms
  FROM marked GROUP BY ALL
)"""

PENDING_SQL = f"""
WITH {LIFE}, {_ISLANDS}, w AS (
  SELECT *, CASE WHEN dropped > 0 AND done_ms IS NOT NULL THEN greatest(done_ms - first_ms, 0) END AS f, CASE WHEN dropped > 0 AND done_ms IS NOT NULL THEN greatest(done_ms - last_ms, 0) END AS l
  FROM islands
)
SELECT count(*) FILTER (done_ms IS NOT NULL) AS processed_records, count(*) FILTER (done_ms IS NULL AND dropped > 0) AS keys_with_pending_drops,
  coalesce(sum(dropped) FILTER (done_ms IS NULL), 0)::BIGINT AS pending_dropped_records,
  count(f) AS first_drop_to_processed_count, round(avg(f), 3) AS first_drop_to_processed_avg_ms, min(f) AS first_drop_to_processed_min_ms, max(f) AS first_drop_to_processed_max_ms,
  count(l) AS last_drop_to_processed_count, round(avg(l), 3) AS last_drop_to_processed_avg_ms, min(l) AS last_drop_to_processed_min_ms, max(l) AS last_drop_to_processed_max_ms
FROM w
"""

_SPREAD = _spread_sql("SELECT 1 AS one, dropped::DOUBLE AS v FROM islands WHERE done_ms IS NOT NULL", "one").replace("SELECT one, count(*)", "SELECT count(*)")
assert len(SUMMARY) == 10

QUERIES = {
    "delivery_audit_by_topic": (delivery_audit_by_topic, DELIVERY_SQL),
    "bounded_ttl_audit": (bounded_ttl_audit, TTL_SQL),
    "audit_line_roundtrip": (audit_line_roundtrip, ROUNDTRIP_SQL),
    "drops_by_reason": (drops_by_reason, DROPS_SQL),
    "retry_attempts": (retry_attempts, RETRY_SQL),
    "ordering_by_partition": (_ordering(audit.BY_PARTITION), _ordering_sql("topic_id, part") + ORDER_TAIL),
    "ordering_by_key": (_ordering(audit.BY_KEY), _ordering_sql("topic_id, part, message_key") + ORDER_TAIL),
    "ordering_groups": (ordering_groups, _ordering_sql("topic_id, part") + GROUPS_TAIL),
    "latency_sla": (latency_sla, SLA_SQL),
    "record_age_by_outcome": (record_age_by_outcome, AGE_SQL),
    "key_outcomes": (key_outcomes, f"WITH {LIFE}, {_OUTCOMES} SELECT * FROM per_key"),
    "key_fairness": (key_fairness, FAIRNESS_SQL),
    "processed_gaps": (processed_gaps, f"WITH {LIFE}, {_GAPS} SELECT * FROM gaps"),
    "gap_thresholds": (
        gap_thresholds,
        f"WITH {LIFE}, {_GAPS} SELECT " + ", ".join(f"count(*) FILTER (max_gap_ms > {s}000) AS keys_over_{s}s" for s in (1, 5, 10, 30)) + " FROM gaps",
    ),
    "freshness_gap_histogram": (
        freshness_gap_histogram,
        f"WITH {LIFE}, {_ISLANDS} SELECT dropped, count(*) AS n FROM islands WHERE done_ms IS NOT NULL GROUP BY dropped",
    ),
    "freshness_gap_distribution": (freshness_gap_distribution, f"WITH {LIFE}, {_ISLANDS}" + _SPREAD),
    "pending_drops": (pending_drops, PENDING_SQL),
    "value_distribution": (value_distribution, "WITH own AS (SELECT 1)" + _spread_sql("SELECT event_type, value AS v FROM events", "event_type")),
}
