"""Experiments: load profiles, SLA criteria, status roll-ups, sizing, schedules.

Profiles and plans are small documents; they are frames all the same, so that a table of thousands of
runs is evaluated in one query.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import compact_mode

_DURATION = {"h": 3600, "m": 60, "s": 1}


def duration_seconds(text: Column) -> Column:
    """Seconds of `1h2m`, `90s` and the like: the sum of all number-unit pairs."""
    parts = [F.regexp_extract_all(text, F.lit(rf"(\d+)\s*{u}"), F.lit(1)) for u in _DURATION]
    hours, minutes, seconds = (F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")) for p in parts)
    return hours * 3600 + minutes * 60 + seconds


def load_profile_phases(profiles: DataFrame, keep: Sequence[str] = (), column: str = "profile") -> DataFrame:
    """keep and schemas.LOAD_PHASE: `0 -> (1m, warmup) -> 100 -> (30s, steady) -> 100` as rows.

    A profile that doesn't alternate rate, (duration, label), rate is an error, as is a phase without a
    positive duration.
    """
    tokens = F.transform(F.split(F.col(column), "->"), lambda t: F.trim(t))
    rows = profiles.select(*keep, F.col(column).alias("_profile"), tokens.alias("_t"))
    phases = F.expr("transform(sequence(1, greatest(size(_t) - 2, 1), 2), k -> struct(get(_t, k - 1) as a, get(_t, k) as d, get(_t, k + 1) as b))")
    rows = rows.select(*keep, "_profile", (F.size("_t") >= 3).alias("_long"), (F.size("_t") % 2 == 1).alias("_odd"), F.posexplode(phases).alias("idx", "p"))
    rate, shape = r"^\d+(\.\d+)?$", r"^\(([^,]+),\s*([^)]+)\)$"
    seconds = duration_seconds(F.regexp_extract("p.d", shape, 1))
    good = F.col("_long") & F.col("_odd") & F.col("p.a").rlike(rate) & F.col("p.b").rlike(rate) & F.col("p.d").rlike(shape) & (seconds > 0)
    checked = F.when(F.coalesce(good, F.lit(False)), seconds).otherwise(
        F.raise_error(F.concat(F.lit("unsupported load profile: "), F.coalesce("_profile", F.lit("null")))).cast("bigint")
    )
    rows = rows.select(
        *keep,
        F.col("idx").cast("int").alias("idx"),
        F.trim(F.regexp_extract("p.d", shape, 2)).alias("name"),
        checked.alias("duration_seconds"),
        F.col("p.a").cast("double").alias("start_percent"),
        F.col("p.b").cast("double").alias("end_percent"),
    )
    upto = Window.partitionBy(*keep).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("duration_seconds").over(upto), F.lit(0)).cast("bigint")
    return rows.select(*keep, "idx", "name", start.alias("start_seconds"), "duration_seconds", "start_percent", "end_percent")


def rate_percent(seconds: Column) -> Column:
    """Percent at a time inside a phase (columns of schemas.LOAD_PHASE), linear between its ends."""
    share = (seconds - F.col("start_seconds")) / F.col("duration_seconds")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share.cast("double")))
    return F.col("start_percent") + (F.col("end_percent") - F.col("start_percent")) * share


def rate_at(times: DataFrame, phases: DataFrame, seconds: str, base_tps: float, closed: bool = False) -> DataFrame:
    """times with phase and rate: a range join with the few phases of a profile.

    Phases are half-open; with `closed` an end belongs to its phase, and the earlier phase has it. A time
    before the start is in the first phase, one after the end in none (rate null).
    """
    t = F.greatest(F.col(seconds), F.lit(0))
    end = F.col("start_seconds") + F.col("duration_seconds")
    inside = (t >= F.col("start_seconds")) & (t < end)
    if closed:
        inside = ((t > F.col("start_seconds")) | ((t == 0) & (F.col("idx") == 0))) & (t <= end)
    named = phases.withColumn("phase", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("phase-"), F.col("idx").cast("string"))))
    few = named.select("phase", "idx", "start_seconds", "duration_seconds", "start_percent", "end_percent")
    # a profile's phases: as many as its text has, on both sides of any data size
    out = times.join(F.broadcast(few), inside, "left")
    return out.select(*times.columns, "phase", (rate_percent(t) * F.lit(base_tps / 100.0)).alias("rate"))


def permits(seconds: DataFrame, rate: str, order: str) -> DataFrame:
    """seconds with `permits`: events due up to each row, the trapezoid under the rate.

    seconds: one row a check of the rate limiter, with `order` in seconds; a profile's length bounds it.
    """
    w = Window.orderBy(order)
    step = (F.coalesce(F.lag(rate).over(w), F.lit(0.0)) + F.col(rate)) / 2 * (F.col(order) - F.coalesce(F.lag(order).over(w), F.col(order)))
    rows = seconds.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return rows.withColumn("permits", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def worker_split(plans: DataFrame, base: str = "base_tps", workers: str = "workers") -> DataFrame:
    """plans with worker and worker_tps: the base split evenly, the first workers take the rest."""
    rows = plans.withColumn("worker", F.explode(F.sequence(F.lit(0), F.col(workers) - 1)))
    share = F.expr(f"{base} div {workers}") + (F.col("worker") < F.col(base) % F.col(workers)).cast("int")
    return rows.withColumn("worker_tps", share.cast("bigint"))


def effective_workers(base: Column, configured: Column) -> Column:
    return F.least(base, configured)


# --- criteria

OPERATORS = ("eq", "lte", "lt", "gte", "gt")


def compare(observed: Column, operator: Column, threshold: Column) -> Column:
    return (
        F.when(operator == "eq", observed == threshold)
        .when(operator == "lte", observed <= threshold)
        .when(operator == "lt", observed < threshold)
        .when(operator == "gte", observed >= threshold)
        .when(operator == "gt", observed > threshold)
        .otherwise(F.raise_error(F.concat(F.lit("unknown operator "), F.coalesce(operator, F.lit("null")))).cast("boolean"))
    )


def evaluate_criteria(criteria: DataFrame, values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, id, title, observed, operator, threshold, status of each criterion (schemas.CRITERION).

    values: by, path (dotted) and value, audit numbers and measurements alike. A missing value is
    INCOMPLETE if the criterion is required, else NOT_EVALUATED.
    """
    wanted = F.when(F.col("source") == "measurement", F.col("measurement")).otherwise(F.concat_ws(".", "path"))
    asked = criteria.select("id", F.coalesce("title", "id").alias("title"), wanted.alias("path"), "operator", "threshold", F.coalesce("required", F.lit(True)).alias("required"))
    if by:
        asked = values.select(*by).distinct().crossJoin(F.broadcast(asked))  # each run by a profile's few criteria
    found = asked.join(values.select(*by, "path", F.col("value").alias("observed")), [*by, "path"], "left")
    missing = F.when(F.col("required"), "INCOMPLETE").otherwise("NOT_EVALUATED")
    passed = F.when(compare(F.col("observed"), F.col("operator"), F.col("threshold")), "PASS").otherwise("FAIL")
    status = F.when(F.col("observed").isNull(), missing).otherwise(passed)
    return found.select(*by, "id", "title", "observed", "operator", "threshold", status.alias("status"))


def component_status(statuses: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """by and status: FAIL before INCOMPLETE; NOT_EVALUATED only if all are; else PASS."""
    has = lambda s: F.count_if(F.col(status) == s) > 0
    rolled = F.when(has("FAIL"), "FAIL").when(has("INCOMPLETE"), "INCOMPLETE")
    rolled = rolled.when(F.count_if(F.col(status) != "NOT_EVALUATED") == 0, "NOT_EVALUATED").otherwise("PASS")
    return statuses.groupBy(*by).agg(rolled.alias("status"))


def overall_status(statuses: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """by and status: FAIL, INCOMPLETE, NOT_EVALUATED, PASS, the first that comes at all."""
    has = lambda s: F.count_if(F.col(status) == s) > 0
    rolled = F.when(has("FAIL"), "FAIL").when(has("INCOMPLETE"), "INCOMPLETE").when(has("NOT_EVALUATED"), "NOT_EVALUATED").otherwise("PASS")
    return statuses.groupBy(*by).agg(rolled.alias("status"))


def rules_match(configured: DataFrame, observed: DataFrame) -> DataFrame:
    """One row, matches: whether both have the same rules (id, topics, max_ms, allowed_exceed_percent)."""
    cols = ["id", F.concat_ws(",", "topics").alias("topics"), F.col("max_ms").cast("bigint").alias("max_ms"), F.col("allowed_exceed_percent").cast("double").alias("allowed")]
    a, b = configured.select(*cols), observed.select(*cols)
    odd = a.exceptAll(b).unionAll(b.exceptAll(a))
    return odd.agg((F.count("*") == 0).alias("matches"))


def latency_rollup(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, processed, measured, exceeded, exceeded_percent, max_observed_ms over a target's rules."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("processed", "measured", "exceeded")]
    out = rules.groupBy(*by).agg(*sums, F.max("max_observed_ms").alias("max_observed_ms"))
    return out.withColumn("exceeded_percent", F.when(F.col("measured") > 0, 100 * F.col("exceeded") / F.col("measured")))


def experiment_span(runs: DataFrame, by: Sequence[str] = (), margin_ms: int = 0) -> DataFrame:
    """by, start_ms, end_ms, duration_seconds: from the first start to the last end, margins outside."""
    out = runs.groupBy(*by).agg((F.min("started_ms") - margin_ms).alias("start_ms"), (F.max("ended_ms") + margin_ms).alias("end_ms"))
    return out.withColumn("duration_seconds", (F.col("end_ms") - F.col("start_ms")) / 1000)


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group, by one aggregation."""
    rest = [c for c in rows.columns if c not in by]
    top = F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in rest))).alias("_top")
    return rows.groupBy(*by).agg(top).select(*by, *(F.col(f"_top._{c}").alias(c) for c in rest))


# --- sizing

MIN_PARTITIONS = 1


def _up_to_multiple(value: Column, multiple: Column) -> Column:
    return F.when(multiple <= 1, value).otherwise(F.ceil(value / multiple) * multiple).cast("bigint")


def size_run(topics: DataFrame, min_partitions: int = MIN_PARTITIONS) -> DataFrame:
    """topics with target_tps, required_parallelism, partitions, worker_concurrency, poll_loop_concurrency.

    topics: base_tps, traffic_percent, average_processing_ms, replicas, knobs (of partitions, workers,
    pollers: what may grow). By Little's law, as many records are in work as come in the time one takes.
    """
    required = F.greatest(F.lit(1), F.ceil(F.col("base_tps") * F.col("traffic_percent") / 100.0 * F.col("average_processing_ms") / 1000.0))
    knob = lambda k: F.array_contains("knobs", k)
    rows = topics.withColumns({"target_tps": F.col("base_tps") * F.col("traffic_percent") / 100.0, "required_parallelism": required.cast("bigint")})
    least = F.lit(min_partitions)
    wanted = F.when(knob("partitions"), F.greatest(least, "required_parallelism")).otherwise(F.greatest(least, "replicas"))
    rows = rows.withColumn("partitions", _up_to_multiple(wanted, F.col("replicas")))
    per = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.col("replicas"))).cast("bigint")
    one = F.lit(1).cast("bigint")
    return rows.withColumns(
        {
            "worker_concurrency": F.when(knob("workers"), per("required_parallelism")).otherwise(one),
            "poll_loop_concurrency": F.when(knob("pollers"), per("partitions")).otherwise(one),
        }
    )


def target_summary(plans: DataFrame, topics: Sequence[str] = ("order", "batch", "telemetry")) -> DataFrame:
    """target and, for each topic, <topic>_mode and <topic>_plan (partitions/workers/pollers)."""
    cell = F.concat_ws("/", *(F.col(c).cast("string") for c in ("partitions", "worker_concurrency", "poll_loop_concurrency")))
    rows = plans.select("target", "topic", compact_mode("processing_mode").alias("mode"), cell.alias("plan"))
    return rows.groupBy("target").pivot("topic", list(topics)).agg(F.first("mode").alias("mode"), F.first("plan").alias("plan"))


# --- schedules

DURATION_STEPS = ("stubs_degradation", "network_degradation", "service_outage")
INSTANT_STEPS = ("pod_delete", "pod_crash", "service_restart")


def overlapping_steps(steps: DataFrame) -> DataFrame:
    """target, earlier, later: pairs of steps (idx, at_seconds, duration_seconds, type, target) that overlap.

    Steps with a duration alone; both are half-open, so one may start where another ends.
    """
    timed = steps.where(F.col("type").isin(*DURATION_STEPS)).select("target", "idx", F.col("at_seconds").alias("a"), (F.col("at_seconds") + F.col("duration_seconds")).alias("b"))
    x, y = timed.alias("x"), timed.alias("y")
    hit = (F.col("x.target") == F.col("y.target")) & (F.col("x.idx") < F.col("y.idx")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))
    return x.join(y, hit).select(F.col("x.target").alias("target"), F.col("x.idx").alias("earlier"), F.col("y.idx").alias("later"))


def schedule(steps: DataFrame) -> DataFrame:
    """place, at_seconds, phase, idx, type, target: starts and ends in order, at equal times ends first."""
    timed = F.col("type").isin(*DURATION_STEPS)
    events = F.array_compact(
        F.array(
            F.struct(F.col("at_seconds").alias("at_seconds"), F.lit(1).alias("rank"), F.lit("start").alias("phase")),
            F.when(timed, F.struct((F.col("at_seconds") + F.col("duration_seconds")).alias("at_seconds"), F.lit(0).alias("rank"), F.lit("end").alias("phase"))),
        )
    )
    rows = steps.select("idx", "type", "target", F.explode(events).alias("e")).select("idx", "type", "target", "e.*")
    place = F.row_number().over(Window.orderBy("at_seconds", "rank", "idx"))
    return rows.select(place.alias("place"), "at_seconds", "phase", "idx", "type", "target")


def cleanup_order(steps: DataFrame) -> DataFrame:
    """place, type, target: what is recovered after an abort, the last step first, each pair once."""
    timed = steps.where(F.col("type").isin(*DURATION_STEPS)).groupBy("type", "target").agg(F.max("idx").alias("idx"))
    return timed.select(F.row_number().over(Window.orderBy(F.desc("idx"))).alias("place"), "type", "target")


# --- sets of names


def duplicates(names: DataFrame, name: str = "name") -> DataFrame:
    """name and n of what is declared more than once."""
    return names.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b doesn't have."""
    return a.subtract(b)


def matched_both_ways(handlers: DataFrame, configs: DataFrame, name: str = "name") -> DataFrame:
    """name and problem: a handler without configuration, or a configuration without handler."""
    a = handlers.join(configs, name, "left_anti").select(name, F.lit("missing_config").alias("problem"))
    b = configs.join(handlers, name, "left_anti").select(name, F.lit("missing_handler").alias("problem"))
    return a.distinct().unionAll(b.distinct())


def health(consumers: DataFrame) -> DataFrame:
    """One row, status, running, registered: DOWN if any failed, OUT_OF_SERVICE if one that should run doesn't.

    consumers: name, failed, auto_startup, running.
    """
    status = F.when(F.count_if("failed") > 0, "DOWN").when(F.count_if(F.col("auto_startup") & ~F.col("running")) > 0, "OUT_OF_SERVICE").otherwise("UP")
    return consumers.agg(status.alias("status"), F.count_if("running").alias("running"), F.count("*").alias("registered"))


def parse_load_profile(text: str) -> list[dict]:
    """The same grammar on the driver, for one profile: rates are integers and a label may be left out."""
    tokens = [t.strip() for t in text.split("->") if t.strip()]
    if len(tokens) < 3 or len(tokens) % 2 == 0 or not all(re.fullmatch(r"\d+", t) for t in tokens[::2]):
        raise ValueError(f"unsupported load profile: {text!r}")
    phases, start = [], 0
    for k in range(1, len(tokens), 2):
        m = re.fullmatch(r"\(\s*(\d+)([smhSMH])\s*(?:,\s*(.+?))?\s*\)", tokens[k])
        if m is None or int(m[1]) == 0:
            raise ValueError(f"unsupported phase {tokens[k]!r} in {text!r}")
        seconds = int(m[1]) * _DURATION[m[2].lower()]
        idx = (k - 1) // 2
        phases.append(
            {"idx": idx, "name": m[3] or f"phase-{idx}", "start_seconds": start, "duration_seconds": seconds,
             "start_percent": float(tokens[k - 1]), "end_percent": float(tokens[k + 1])}
        )
        start += seconds
    return phases
