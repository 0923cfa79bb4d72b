"""Experiments, metrics and scalar functions: literal documents, and series derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import audit, codecs, experiments, metrics, modes, offsets
from tidemark.plans import progress
from tidemark.sources import derived, documents
from tidemark.sources import metrics as series
from tidemark.sources.generator import simulated_load

from .common import LOG, RECORDS, plain

PROFILES = [
    ("ramp", "0 -> (1m, warmup) -> 100 -> (30s, steady) -> 100"),
    ("long", "10 -> (1h2m, climb) -> 50 -> (90s, hold) -> 50 -> (10s, cool down) -> 0"),
]
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
STEPS = [
    (1, 10, 60, "network_degradation", "kafka"),
    (2, 30, 20, "service_outage", "kafka"),
    (3, 30, 20, "service_outage", "redis"),
    (4, 50, None, "pod_delete", "demo"),
    (5, 70, 10, "network_degradation", "kafka"),
    (6, 50, 30, "stubs_degradation", "stubs"),
]
CRITERIA = {
    "criteria": [
        {"id": "missing", "path": ["totals", "missing_terminal"], "operator": "eq", "threshold": 0},
        {"id": "enough", "path": ["totals", "processed"], "operator": "gte", "threshold": 10},
        {"id": "dropped", "path": ["totals", "dropped"], "operator": "lt", "threshold": 1},
        {"id": "late", "source": "measurement", "measurement": "latency_p95_ms", "operator": "lte", "threshold": 1000},
        {"id": "cpu", "source": "measurement", "measurement": "cpu_average_cores", "operator": "lte", "threshold": 4, "required": False},
    ]
}
PLANS = [
    ("a", "order", "AT_LEAST_ONCE_KEY_ORDERING", 10_000, 40.0, 12.5, 3, ["partitions", "workers"]),
    ("a", "batch", "AT_LEAST_ONCE_NO_ORDERING", 10_000, 20.0, 30.0, 3, ["workers"]),
    ("a", "telemetry", "FRESHNESS_FIRST_DROP_OLDEST", 10_000, 40.0, 5.0, 3, ["pollers", "partitions"]),
    ("b", "order", "HARDCODED_ORDER", 7, 1.0, 1.0, 1, ["partitions"]),
    ("b", "telemetry", "FRESHNESS_FIRST_REPLACE_PENDING_BY_KEY", 25_000, 100.0, 41.0, 4, ["pollers", "partitions", "workers"]),
]


def load_profile_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(experiments.load_profile_phases(spark.createDataFrame(PROFILES, "plan string, profile string"), ["plan"]))


def _phases(spark: SparkSession) -> DataFrame:
    return experiments.load_profile_phases(spark.createDataFrame(PROFILES[:1], "plan string, profile string"))


def load_rate_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = derived.events(spark, sf_dir).select("event_id", (F.col("event_id") % 120 - 5).alias("second"))
    out = experiments.rate_at(times, _phases(spark), "second", 2500.0)
    return plain(out.withColumn("rate", F.round("rate", 6)))


def load_phase_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = derived.events(spark, sf_dir).select("event_id", (F.col("event_id") % 100).alias("second"))
    out = experiments.rate_at(times, _phases(spark), "second", 100.0, closed=True)
    return plain(out.withColumn("rate", F.round("rate", 6)))


def load_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = spark.range(0, 91).select(F.col("id").alias("second"))
    rates = experiments.rate_at(seconds, _phases(spark), "second", 2500.0, closed=True)
    return plain(experiments.permits(rates.select("second", "rate"), "rate", "second").select("second", F.round("permits", 6).alias("permits")))


def _steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STEPS, "idx int, at_seconds int, duration_seconds int, type string, target string")


def chaos_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(experiments.overlapping_steps(_steps(spark)))


def chaos_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(experiments.schedule(_steps(spark)))


def chaos_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(experiments.cleanup_order(_steps(spark)))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit numbers and a measurement of each topic as a run's values: run, path, value."""
    keys = audit.lifecycle(derived.audit_records(derived.events(spark, sf_dir)))
    counts = audit.named(audit.audit_counts(None, keys)).withColumnRenamed("topic", "run")
    wanted = {f"totals.{c}": F.col(c) for c in ("missing_terminal", "processed", "dropped")}
    from tidemark.functions.stats import long_form

    values = long_form(counts, wanted, ["run"], "path", "value")
    p95 = counts.where("run <> 'all'").select("run", F.lit("latency_p95_ms").alias("path"), (F.length("run") * 50).cast("double").alias("value"))
    return values.unionByName(p95)


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.evaluate_criteria(documents.criteria(spark, CRITERIA), _values(spark, sf_dir), ["run"])


def sla_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_criteria(spark, sf_dir).drop("title"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _criteria(spark, sf_dir)
    component = experiments.component_status(found, ["run"]).withColumnRenamed("status", "component")
    overall = experiments.overall_status(found.where("id in ('enough', 'late', 'cpu')"), ["run"]).withColumnRenamed("status", "overall")
    return plain(component.join(overall, "run"))


def run_plan_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.size_run(_plans(spark))
    return plain(out.select("target", "topic", "target_tps", "required_parallelism", "partitions", "worker_concurrency", "poll_loop_concurrency"))


def _plans(spark: SparkSession) -> DataFrame:
    schema = "target string, topic string, processing_mode string, base_tps int, traffic_percent double, average_processing_ms double, replicas int, knobs array<string>"
    return spark.createDataFrame(PLANS, schema)


def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(experiments.target_summary(experiments.size_run(_plans(spark))))


def worker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = derived.events(spark, sf_dir).select((F.col("event_id") % 1000 * 7 + 3).alias("base_tps"), (F.col("event_id") % 5 + 1).alias("workers"))
    return plain(experiments.worker_split(plans))


def experiment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.log(derived.events(spark, sf_dir)).select("topic_id", F.col("kafka_ts_ms").alias("started_ms"), (F.col("kafka_ts_ms") + F.col("delay_ms")).alias("ended_ms"))
    return plain(experiments.experiment_span(runs, ["topic_id"], 120_000))


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.log(derived.events(spark, sf_dir)).select("message_key", "event_id", "event_type", "offset")
    return plain(experiments.latest(rows, ["message_key"], ["event_id"]))


def validation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = spark.createDataFrame([("orders",), ("batches",), ("orders",)], "name string")
    configs = spark.createDataFrame([("orders",), ("telemetry",)], "name string")
    repeated = experiments.duplicates(handlers).select("name", F.lit("duplicate").alias("problem"))
    tags = spark.createDataFrame([("topic",), ("tenant",)], "name string")
    reserved = spark.createDataFrame([(t,) for t in metrics.RESERVED_TAGS], "name string")
    clash = tags.intersect(reserved).select("name", F.lit("reserved").alias("problem"))
    undeclared = experiments.difference(tags, spark.createDataFrame([("tenant",)], "name string")).select("name", F.lit("undeclared").alias("problem"))
    return plain(experiments.matched_both_ways(handlers, configs).unionAll(repeated).unionAll(clash).unionAll(undeclared))


def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", False, True, True), ("b", False, True, False), ("c", False, False, False)]
    return plain(experiments.health(spark.createDataFrame(rows, "name string, failed boolean, auto_startup boolean, running boolean")))


# --- metrics

SCHEMA = metrics.TagSchema("shop", [metrics.TagDefinition("event_type"), metrics.TagDefinition("tenant", "none")], {"region": "eu"})


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derived.records(derived.events(spark, sf_dir))
    failed = F.col("value") == "error"
    return records.select(
        "topic", "arrival", "value", F.when(failed, "failed").otherwise("processed").alias("outcome"), F.col("delay_ms").alias("duration_ms"),
        C.end_to_end_latency_ms("now_ms", "timestamp_ms").alias("end_to_end_ms"), F.when(failed & (F.col("arrival") % 2 == 0), "TimeoutError").alias("error"),
        F.col("now_ms").alias("processed_ms"), "window",
    )


def record_metrics_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(metrics.record_timers(_outcomes(spark, sf_dir), SCHEMA, "shop-1", {"event_type": F.col("value")}))


def dropped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = modes.drop_oldest(derived.records(derived.events(spark, sf_dir)), progress.CAPACITY, max_age_ms=progress.MAX_AGE_MS)
    return plain(metrics.drop_counters(decided, SCHEMA, "shop-1"))


def retry_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = _outcomes(spark, sf_dir).where("outcome = 'failed'").select("topic", "value", "error", F.explode(F.sequence(F.lit(1), (F.col("arrival") % 3 + 1).cast("int"))).alias("attempt"))
    return plain(metrics.retry_counters(tries, SCHEMA, "shop-1", {"event_type": F.col("value")}))


def model_call_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derived.events(spark, sf_dir).select(
        F.lit("eta").alias("model"), F.col("event_type").alias("operation"), F.when(F.col("event_id") % 2 == 0, "sync").otherwise("suspend").alias("client_mode"),
        F.lit("http").alias("transport"), F.when(F.col("event_id") % 20 == 0, "error").otherwise("success").alias("outcome"),
        C.latency_bucket_ms(F.col("event_id") % 100).alias("duration_ms"),
    )
    out = metrics.model_calls(calls)
    return plain(out.withColumns({"total": F.col("total").cast("bigint"), "max": F.col("max").cast("bigint")}))


def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = metrics.bucket_counts(derived.events(spark, sf_dir), "value", BOUNDS, ["event_type"])
    parts = [metrics.histogram_quantile(buckets, q, ["event_type"]).withColumn("q", F.lit(q)) for q in (0.0, 0.5, 0.95, 0.999)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return plain(out.withColumn("value", F.round("value", 6)))


def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.bucket_counts(derived.events(spark, sf_dir), "value", BOUNDS, ["event_type"])
    return plain(out.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le"))))


def average_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of each partition of a topic, restarted now and then: increases over a day, as a rate."""
    log = derived.log(derived.events(spark, sf_dir))
    counter = log.select("topic_id", "partition", (F.col("offset") % 1000).cast("double").alias("value"), F.col("kafka_ts_ms").alias("timestamp_ms"))
    start = 1704067200000 + 86_400_000
    steps = metrics.increase(counter, ["topic_id", "partition"], start, start + 86_400_000)
    return plain(metrics.average_rate(steps, 86_400.0, ["topic_id"]).withColumn("per_second", F.round("per_second", 9)))


def standard_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.standard_measurements(_outcomes(spark, sf_dir), 1704067200000, 10 * 86_400.0, [1000.0, 60_000.0, 3_600_000.0, 86_400_000.0, 864_000_000.0])
    return plain(out.withColumn("value", F.round("value", 6)))


def finite_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = derived.events(spark, sf_dir).select(F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 10 == 1, float("inf")).otherwise(F.col("event_id") * 1.0).alias("value"))
    return plain(metrics.scalar(odd))


def simulation_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.events(spark, sf_dir).select(F.concat(F.lit("s."), F.col("event_type")).alias("stage"))
    return plain(metrics.stage_counts(rows, "stage", ["s.click", "s.view", "s.none"]))


def publisher_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = derived.events(spark, sf_dir).select(F.col("event_type").alias("stream"), F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 11 != 0, "acked").alias("outcome"))
    return plain(metrics.publisher_counters(sends))


def generator_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    emits = derived.events(spark, sf_dir).select(F.col("event_type").alias("generator"), (F.col("event_id") % 4).alias("emitted"), (F.col("event_id") % 3).alias("delegated"), (F.col("event_id") % 4 == 0).alias("blocked"))
    return plain(metrics.generator_counters(emits))


# --- scalars and sources


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.log(derived.events(spark, sf_dir))
    text = F.concat(F.lit("  Run "), F.col("event_type"), F.lit("/#"), F.col("message_key"), F.lit(" !"))
    return plain(
        log.select(
            "event_id",
            C.safe_component(text).alias("slug"),
            C.safe_component(text, lowercase=False).alias("component"),
            C.floor_minute("kafka_ts_ms").alias("floor_minute"),
            C.ceil_minute("kafka_ts_ms").alias("ceil_minute"),
            C.unix_ns("kafka_ts_ms").alias("ns"),
            C.regulatory_trace_id("kafka_ts_ms", 2, 5).alias("trace_id"),
            C.entity_id("order", F.col("event_id") * 1000, 6).alias("entity_id"),
            C.java_hash(F.concat("message_key", "event_type", F.lit("🜁é"))).alias("java_hash"),
            C.round_half_up(F.col("delay_ms") / 8).alias("rounded"),
            F.round(C.ratio(F.col("delay_ms"), F.col("event_id") % 5), 6).alias("ratio"),
            C.iso_instant("kafka_ts_ms").alias("iso"),
            C.parse_instant(C.iso_instant("kafka_ts_ms")).alias("parsed"),
            C.compact_mode(F.when(F.col("event_id") % 2 == 0, "AT_LEAST_ONCE_KEY_ORDERING").otherwise("FRESHNESS_FIRST_DROP_OLDEST")).alias("mode"),
            F.array_join(C.referenced_metrics(F.concat(F.lit("sum(rate(up_x[5m])) / label_values(jobs, "), "event_type", F.lit(") + kafka_lag{a=\"b\"}"))), ",").alias("metrics"),
        )
    )


def base64_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("event_type", F.lit("?>~é"), F.col("event_id").cast("string"))
    rows = derived.events(spark, sf_dir).select("event_id", text.alias("t"), C.base64_url(text.cast("binary")).alias("encoded"))
    return plain(rows.select("event_id", "encoded", (C.unbase64_url("encoded").cast("string") == F.col("t")).alias("restored")))


REPORTS = [
    ("tool", "GROUP g\nMEMBERS 3\nTOTAL-LAG 42\n\nTOPIC PARTITION LAG\na 0 7\n"),
    ("sums", "GROUP g\nMEMBERS 9 9 9\nTOPIC PARTITION LAG\na 0 7\na 1 -2\nb 0 5\n"),
    ("none", "nothing"),
]
TABLES = [("rows", "\nGROUP TOPIC PARTITION LAG HOST\ng a 0 4 h\ng a 1 - h\ng a 2 -3 h\n"), ("empty", "GROUP TOPIC PARTITION LAG\n")]


def lag_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = series.lag_of_description(spark.createDataFrame(REPORTS, "name string, output string"), ["name"])
    b = series.lag_of_groups(spark.createDataFrame(TABLES, "name string, output string"), ["name"])
    return plain(a.unionByName(b))


def commit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of what is out of order, encoded for a commit (no SQL: compressed payloads)."""
    return codecs.encode_snapshots(offsets.snapshots(*progress._progress(spark, sf_dir)))


def workshop_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated load of two workers (no SQL: a state machine), by topic and type of event."""
    out = simulated_load(spark, "0 -> (2s, warmup) -> 100 -> (3s, steady) -> 100", 2, base_tps=200, cauldrons=8)
    return out.groupBy("topic", "event_type").agg(F.count("*").alias("events"), F.count_distinct("key").alias("keys"))


_PHASES = "phases AS (SELECT * FROM (VALUES (0, 'warmup', 0, 60, 0.0, 100.0), (1, 'steady', 60, 30, 100.0, 100.0)) v(idx, name, start, len, a, b))"
_STEPS = "steps AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {at}, {'NULL' if n is None else n}, '{t}', '{g}')" for i, at, n, t, g in STEPS
) + ") v(idx, at_seconds, len, type, target))"
_TIMED = "timed AS (SELECT * FROM steps WHERE type IN ('stubs_degradation', 'network_degradation', 'service_outage'))"

_CRITERIA_SQL = """
vals AS (
  SELECT topic AS run, 'totals.missing_terminal' AS path, missing_terminal::DOUBLE AS value FROM counts UNION ALL SELECT topic, 'totals.processed', processed FROM counts
  UNION ALL SELECT topic, 'totals.dropped', dropped FROM counts UNION ALL SELECT topic, 'latency_p95_ms', length(topic) * 50 FROM counts WHERE topic <> 'all'
),
asked AS (SELECT * FROM (VALUES ('missing', 'totals.missing_terminal', 'eq', 0.0::DOUBLE, true), ('enough', 'totals.processed', 'gte', 10.0, true), ('dropped', 'totals.dropped', 'lt', 1.0, true),
  ('late', 'latency_p95_ms', 'lte', 1000.0, true), ('cpu', 'cpu_average_cores', 'lte', 4.0, false)) v(id, path, operator, threshold, required)),
found AS (
  SELECT r.run, a.id, v.value AS observed, a.operator, a.threshold,
    CASE WHEN v.value IS NULL THEN CASE WHEN required THEN 'INCOMPLETE' ELSE 'NOT_EVALUATED' END
      WHEN CASE operator WHEN 'eq' THEN value = threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold ELSE value <= threshold END THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT DISTINCT run FROM vals) r CROSS JOIN asked a LEFT JOIN vals v ON v.run = r.run AND v.path = a.path
)"""


def _with_counts(tail: str) -> str:
    from .audit import DELIVERY_SQL

    head, _, rest = DELIVERY_SQL.strip().partition("WITH ")
    body, _, select = rest.rpartition("\nSELECT m.topic")
    return f"WITH {body}, counts AS (SELECT m.topic{select}), {_CRITERIA_SQL} {tail}"


_ROLL = """
SELECT run, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'INCOMPLETE') THEN 'INCOMPLETE' WHEN bool_and(status = 'NOT_EVALUATED') THEN 'NOT_EVALUATED' ELSE 'PASS' END AS component,
  CASE WHEN bool_or(status = 'FAIL' AND id IN ('enough', 'late', 'cpu')) THEN 'FAIL' WHEN bool_or(status = 'INCOMPLETE' AND id IN ('enough', 'late', 'cpu')) THEN 'INCOMPLETE'
    WHEN bool_or(status = 'NOT_EVALUATED' AND id IN ('enough', 'late', 'cpu')) THEN 'NOT_EVALUATED' ELSE 'PASS' END AS overall
FROM found GROUP BY run"""

_PLANS = "plans AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{n}', '{m}', {b}, {p}::DOUBLE, {ms}::DOUBLE, {r}, {k})" for t, n, m, b, p, ms, r, k in PLANS
) + ") v(target, topic, mode, base, pct, ms, r, knobs))"
_SIZED = """
need AS (SELECT *, base * pct / 100.0 AS target_tps, greatest(1, ceil(base * pct / 100.0 * ms / 1000.0))::BIGINT AS required FROM plans),
parts AS (SELECT *, (CASE WHEN r <= 1 THEN 1 ELSE r END * ceil(CASE WHEN list_contains(knobs, 'partitions') THEN greatest(1, required) ELSE greatest(1, r) END / r::DOUBLE))::BIGINT AS partitions FROM need),
sized AS (SELECT target, topic, mode, target_tps::DOUBLE AS target_tps, required AS required_parallelism, partitions,
  CASE WHEN list_contains(knobs, 'workers') THEN greatest(1, ceil(required / r::DOUBLE))::BIGINT ELSE 1 END AS worker_concurrency,
  CASE WHEN list_contains(knobs, 'pollers') THEN greatest(1, ceil(partitions / r::DOUBLE))::BIGINT ELSE 1 END AS poll_loop_concurrency FROM parts)"""

_OUT = RECORDS + """,
outs AS (SELECT topic, arrival, val, CASE WHEN val = 'error' THEN 'failed' ELSE 'processed' END AS outcome, delay, greatest(now_ms - timestamp_ms, 0) AS e2e,
  CASE WHEN val = 'error' AND arrival % 2 = 0 THEN 'TimeoutError' END AS error, now_ms, win FROM rec)"""

_BUCKETS = """
edges AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'infinity'::DOUBLE]) AS le),
types AS (SELECT DISTINCT event_type FROM events),
buckets AS (SELECT t.event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value <= le) AS count FROM types t, edges)"""


def _quantile_sql(buckets: str, by: str, qs: str) -> str:
    return f"""
WITH {buckets}, qs AS (SELECT unnest({qs}) AS q),
step AS (SELECT *, coalesce(lag(count) OVER w, 0) AS below, lag(le) OVER w AS low, max(count) OVER (PARTITION BY {by}) AS total FROM buckets WINDOW w AS (PARTITION BY {by} ORDER BY le)),
hit AS (SELECT {by}, q, le, below, low, count, q * total AS rank, row_number() OVER (PARTITION BY {by}, q ORDER BY le) AS k FROM step, qs WHERE count >= q * total AND total > 0)"""


_JAVA = "((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_UNITS = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024]::BIGINT[] END))"

SCALAR_SQL = f"""
WITH {LOG}, t AS (SELECT *, '  Run ' || event_type || '/#' || message_key || ' !' AS text, message_key || event_type || '🜁é' AS s FROM log)
SELECT event_id, 'run-' || event_type || '-' || message_key AS slug, 'Run-' || event_type || '-' || message_key AS component,
  sent - sent % 60000 AS floor_minute, CASE WHEN sent % 60000 = 0 THEN sent ELSE sent - sent % 60000 + 60000 END AS ceil_minute, sent * 1000000 AS ns,
  'mrb-2-5-' || (sent // 1000) AS trace_id, 'order-0-0-' || CASE WHEN length((event_id * 1000)::VARCHAR) >= 6 THEN (event_id * 1000)::VARCHAR ELSE lpad((event_id * 1000)::VARCHAR, 6, '0') END AS entity_id,
  list_reduce(list_prepend(0::BIGINT, {_UNITS}), lambda a, x: {_JAVA}) AS java_hash, floor(delay / 8.0 + 0.5)::BIGINT AS rounded,
  round(CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE delay / (event_id % 5)::DOUBLE END, 6)::DOUBLE AS ratio,
  strftime(make_timestamp(sent * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((sent % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, sent AS parsed,
  CASE WHEN event_id % 2 = 0 THEN 'KEY_ORDERING' ELSE 'FF_DROP_OLDEST' END AS mode, 'jobs,kafka_lag,up_x' AS metrics
FROM t
"""

QUERIES = {
    "load_profile_phases": (
        load_profile_phases,
        "SELECT * FROM (VALUES ('ramp', 0::BIGINT, 'warmup', 0::BIGINT, 60::BIGINT, 0.0::DOUBLE, 100.0::DOUBLE), ('ramp', 1, 'steady', 60, 30, 100.0, 100.0), ('long', 0, 'climb', 0, 3720, 10.0, 50.0), "
        "('long', 1, 'hold', 3720, 90, 50.0, 50.0), ('long', 2, 'cool down', 3810, 10, 50.0, 0.0)) v(plan, idx, name, start_seconds, duration_seconds, start_percent, end_percent)",
    ),
    "load_rate_at": (
        load_rate_at,
        f"WITH {_PHASES}, t AS (SELECT event_id, event_id % 120 - 5 AS second FROM events) SELECT event_id, second, name AS phase, "
        "round((a + (b - a) * (greatest(second, 0) - start) / len::DOUBLE) * 25, 6)::DOUBLE AS rate FROM t LEFT JOIN phases ON greatest(second, 0) >= start AND greatest(second, 0) < start + len",
    ),
    "load_phase_closed": (
        load_phase_closed,
        f"WITH {_PHASES}, t AS (SELECT event_id, event_id % 100 AS second FROM events) SELECT event_id, second, name AS phase, round(a + (b - a) * (second - start) / len::DOUBLE, 6)::DOUBLE AS rate "
        "FROM t LEFT JOIN phases ON (second > start OR (second = 0 AND idx = 0)) AND second <= start + len",
    ),
    "load_permits": (
        load_permits,
        "SELECT range AS second, round(CASE WHEN range <= 60 THEN 2500.0 * range * range / 120 ELSE 75000 + (range - 60) * 2500.0 END, 6)::DOUBLE AS permits FROM range(0, 91)",
    ),
    "chaos_overlap": (
        chaos_overlap,
        f"WITH {_STEPS}, {_TIMED} SELECT x.target, x.idx::BIGINT AS earlier, y.idx::BIGINT AS later FROM timed x JOIN timed y ON x.target = y.target AND x.idx < y.idx "
        "AND x.at_seconds < y.at_seconds + y.len AND y.at_seconds < x.at_seconds + x.len",
    ),
    "chaos_schedule": (
        chaos_schedule,
        f"WITH {_STEPS}, {_TIMED}, e AS (SELECT at_seconds, 1 AS rank, 'start' AS phase, idx, type, target FROM steps UNION ALL SELECT at_seconds + len, 0, 'end', idx, type, target FROM timed) "
        "SELECT row_number() OVER (ORDER BY at_seconds, rank, idx) AS place, at_seconds::BIGINT AS at_seconds, phase, idx::BIGINT AS idx, type, target FROM e",
    ),
    "chaos_cleanup": (
        chaos_cleanup,
        f"WITH {_STEPS}, {_TIMED}, g AS (SELECT type, target, max(idx) AS idx FROM timed GROUP BY ALL) SELECT row_number() OVER (ORDER BY idx DESC) AS place, type, target FROM g",
    ),
    "sla_criteria": (sla_criteria, _with_counts("SELECT run, id, observed, operator, threshold, status FROM found")),
    "status_rollup": (status_rollup, _with_counts(_ROLL)),
    "run_plan_sizing": (run_plan_sizing, f"WITH {_PLANS}, {_SIZED} SELECT * EXCLUDE (mode) FROM sized"),
    "target_summary": (
        target_summary,
        f"WITH {_PLANS}, {_SIZED}, c AS (SELECT target, topic, replace(replace(regexp_replace(mode, '^AT_LEAST_ONCE_', ''), 'FRESHNESS_FIRST_', 'FF_'), 'HARDCODED_', 'HC_') AS m, "
        "partitions || '/' || worker_concurrency || '/' || poll_loop_concurrency AS p FROM sized) SELECT target, "
        + ", ".join(f"max(m) FILTER (topic = '{t}') AS {t}_mode, max(p) FILTER (topic = '{t}') AS {t}_plan" for t in ("order", "batch", "telemetry"))
        + " FROM c GROUP BY target",
    ),
    "worker_split": (
        worker_split,
        "WITH p AS (SELECT event_id % 1000 * 7 + 3 AS base_tps, event_id % 5 + 1 AS workers FROM events) SELECT base_tps, workers, w AS worker, "
        "base_tps // workers + (w < base_tps % workers)::BIGINT AS worker_tps FROM p, LATERAL (SELECT unnest(range(0, workers)) AS w)",
    ),
    "experiment_spans": (
        experiment_spans,
        f"WITH {LOG} SELECT topic_id::BIGINT AS topic_id, min(sent) - 120000 AS start_ms, max(sent + delay) + 120000 AS end_ms, (max(sent + delay) - min(sent) + 240000) / 1000 AS duration_seconds FROM log GROUP BY 1",
    ),
    "latest_record": (
        latest_record,
        f'WITH {LOG} SELECT message_key, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(off, event_id) AS "offset" FROM log GROUP BY message_key',
    ),
    "validation_sets": (
        validation_sets,
        "SELECT * FROM (VALUES ('batches', 'missing_config'), ('telemetry', 'missing_handler'), ('orders', 'duplicate'), ('topic', 'reserved'), ('topic', 'undeclared')) v(name, problem)",
    ),
    "health_rollup": (health_rollup, "SELECT 'OUT_OF_SERVICE' AS status, 1::BIGINT AS running, 3::BIGINT AS registered"),
    "record_metrics_by_tag": (
        record_metrics_by_tag,
        f"WITH {_OUT}, s AS (SELECT *, 'record.process.duration' AS suffix, delay AS ms FROM outs WHERE outcome = 'processed' UNION ALL SELECT *, 'record.end.to.end.duration', e2e FROM outs WHERE outcome = 'processed' "
        "UNION ALL SELECT *, 'record.failed.duration', delay FROM outs WHERE outcome = 'failed') SELECT 'shop.consumer.' || suffix AS metric, 'shop-1' AS consumer_id, topic, coalesce(val, 'NONE') AS event_type, 'none' AS tenant, "
        "'eu' AS region, CASE WHEN outcome = 'failed' THEN coalesce(error, 'unknown') END AS error, count(*) AS count, sum(ms)::BIGINT AS total_ms, max(ms)::BIGINT AS max_ms FROM s GROUP BY ALL",
    ),
    "dropped_metrics": (
        dropped_metrics,
        f"WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY arrival DESC) AS newest FROM rec), d AS (SELECT topic, CASE WHEN newest > {progress.CAPACITY} THEN 'queue_overflow' "
        f"WHEN timestamp_ms > 0 AND now_ms - timestamp_ms > {progress.MAX_AGE_MS} THEN 'stale_age' END AS reason FROM n) "
        "SELECT 'shop.consumer.record.dropped' AS metric, 'shop-1' AS consumer_id, topic, reason, count(*) AS count FROM d WHERE reason IS NOT NULL GROUP BY ALL",
    ),
    "retry_metrics": (
        retry_metrics,
        f"WITH {_OUT}, a AS (SELECT *, unnest(range(1, arrival % 3 + 2)) AS attempt FROM outs WHERE outcome = 'failed') SELECT 'shop.consumer.record.retry' AS metric, 'shop-1' AS consumer_id, topic, val AS event_type, "
        "'none' AS tenant, 'eu' AS region, attempt, error, count(*) AS count FROM a GROUP BY ALL",
    ),
    "model_call_timers": (
        model_call_timers,
        "WITH c AS (SELECT event_type AS operation, CASE WHEN event_id % 2 = 0 THEN 'sync' ELSE 'suspend' END AS client_mode, CASE WHEN event_id % 20 = 0 THEN 'error' ELSE 'success' END AS outcome, "
        "CASE WHEN event_id % 100 < 90 THEN 40 WHEN event_id % 100 < 95 THEN 80 WHEN event_id % 100 < 99 THEN 160 ELSE 300 END AS ms FROM events) "
        "SELECT 'eta' AS model, operation, client_mode, 'http' AS transport, outcome, count(*) AS count, sum(ms)::BIGINT AS total, max(ms)::BIGINT AS max FROM c GROUP BY ALL",
    ),
    "histogram_quantile": (
        histogram_quantile,
        _quantile_sql(_BUCKETS, "event_type", "[0.0::DOUBLE, 0.5, 0.95, 0.999]")
        + " SELECT event_type, q, round(CASE WHEN le = 'infinity'::DOUBLE THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * CASE WHEN count > below THEN (rank - below) / (count - below) ELSE 0 END END, 6)::DOUBLE AS value FROM hit WHERE k = 1",
    ),
    "histogram_buckets": (
        histogram_buckets,
        f"WITH {_BUCKETS} SELECT event_type, CASE WHEN le = 'infinity'::DOUBLE THEN -1.0 ELSE le END::DOUBLE AS le, count FROM buckets",
    ),
    "average_rate": (
        average_rate,
        f"WITH {LOG}, s AS (SELECT topic_id, part, (off % 1000)::DOUBLE AS v, sent FROM log WHERE sent BETWEEN 1704153600000 AND 1704240000000), d AS (SELECT topic_id, part, v, lag(v) OVER (PARTITION BY topic_id, part ORDER BY sent) AS b FROM s), "
        "i AS (SELECT topic_id, part, coalesce(sum(CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END), 0) AS inc FROM d GROUP BY ALL) SELECT topic_id::BIGINT AS topic_id, round(sum(inc) / 86400.0, 9)::DOUBLE AS per_second FROM i GROUP BY 1",
    ),
    "standard_measurements": (
        standard_measurements,
        f"WITH {_OUT}, o AS (SELECT * FROM outs WHERE now_ms BETWEEN 1704067200000 AND 1704067200000 + 864000000), edges AS (SELECT unnest([1000.0, 60000.0, 3600000.0, 86400000.0, 864000000.0, 'infinity'::DOUBLE]) AS le), "
        "buckets AS (SELECT 1 AS one, le, (SELECT count(*) FROM o WHERE e2e <= le) AS count FROM edges), qs AS (SELECT unnest([0.95::DOUBLE, 0.99]) AS q), "
        "step AS (SELECT *, coalesce(lag(count) OVER (ORDER BY le), 0) AS below, lag(le) OVER (ORDER BY le) AS low, max(count) OVER () AS total FROM buckets), "
        "hit AS (SELECT *, q * total AS rank, row_number() OVER (PARTITION BY q ORDER BY le) AS k FROM step, qs WHERE count >= q * total AND total > 0), last AS (SELECT * FROM qs LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (q)) "
        "SELECT CASE WHEN q = 0.95::DOUBLE THEN 'latency_p95_ms' ELSE 'latency_p99_ms' END AS measurement, round(CASE WHEN le = 'infinity'::DOUBLE THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (rank - below) / (count - below) END, 6)::DOUBLE AS value FROM last "
        "UNION ALL SELECT 'throughput_average_rps', round(count(*) / 864000.0, 6)::DOUBLE FROM o",
    ),
    "finite_scalar": (finite_scalar, "SELECT sum(event_id)::DOUBLE AS value FROM events WHERE event_id % 10 > 1"),
    "simulation_stages": (
        simulation_stages,
        "SELECT count(*) FILTER (event_type = 'click') AS s_click, count(*) FILTER (event_type = 'view') AS s_view, 0::BIGINT AS s_none FROM events",
    ),
    "publisher_counters": (
        publisher_counters,
        "SELECT event_type AS stream, count(*) AS sent, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) AS acked, count(*) FILTER (event_id % 7 = 0) AS failed FROM events GROUP BY 1",
    ),
    "generator_counters": (
        generator_counters,
        "SELECT event_type AS generator, count(*) AS total, sum(event_id % 4)::BIGINT AS emitted, sum(event_id % 3)::BIGINT AS delegated, count(*) FILTER (event_id % 4 = 0) AS blocked FROM events GROUP BY 1",
    ),
    "scalar_functions": (scalar_functions, SCALAR_SQL),
    "base64_payload": (
        base64_payload,
        "SELECT event_id, translate(rtrim(base64(encode(event_type || '?>~é' || event_id)), '='), '+/', '-_') AS encoded, true AS restored FROM events",
    ),
    "lag_reports": (lag_reports, "SELECT * FROM (VALUES ('tool', 42::BIGINT), ('sums', 12), ('none', 0), ('rows', 4), ('empty', NULL)) v(name, lag)"),
    "commit_metadata": (commit_metadata, None),
    "workshop_load": (workshop_load, None),
}
