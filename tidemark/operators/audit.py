"""Delivery audit: publishes matched with terminal outcomes, and what follows from the match.

Records are rows of schemas.AUDIT with `arrival`, an orderable column that no two rows share. The
match is one aggregation by (topic, partition, offset): for each kind of record how many came and the
first of them. From a key's first arrivals alone follows when it closed and which outcomes still
counted as open, so nothing is replayed in order. Counts by topic are summed first and the totals are
made of those few rows.

A key closes as soon as it has a publish and an outcome. `open` outcomes are those that came before or
with the closing one: the first `k` kinds, k = 1 if the publish came first, else the number of kinds
before it, or all of them without a publish.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, round6, topic_name_of
from tidemark.functions.scans import prefix, previous
from tidemark.functions.stats import age_stats, distribution, histogram, long_form

KEY = ["topic_id", "partition", "offset"]
TERMINAL = {"C": "processed", "F": "failed", "D": "dropped"}
KINDS = {"P": "published"} | TERMINAL
TELEMETRY_TOPIC = 3


def valid_key() -> Column:
    """Dry-run publishes have neither partition nor offset: they are read, not matched."""
    return (F.col("partition") >= 0) & (F.col("offset") >= 0)


def lifecycle(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a key (and `by`): n_<kind>, the first record of each kind and what is open.

    Columns: KEY, by, n_P, n_C, n_F, n_D, n_R, P, C, F, D (structs arrival, audit_ts_ms, kafka_ts_ms,
    message_key, drop_reason), kinds (outcomes seen), open_kinds, open_C, open_F, open_D and first_kind.
    Rows of an invalid key stand together under it.
    """
    first = F.struct("arrival", "audit_ts_ms", "kafka_ts_ms", "message_key", "drop_reason")
    out = records.groupBy(*KEY, *by).agg(
        *(F.count_if(F.col("record_type") == k).alias(f"n_{k}") for k in (*KINDS, "R")),
        *(F.min(F.when(F.col("record_type") == k, first)).alias(k) for k in KINDS),
    )
    kinds = sum((F.col(t).isNotNull().cast("int") for t in TERMINAL), F.lit(0))
    before = sum((F.coalesce(F.col(f"{t}.arrival") < F.col("P.arrival"), F.lit(False)).cast("int") for t in TERMINAL), F.lit(0))
    out = out.withColumn("kinds", kinds)
    k = F.when(F.col("P").isNull() | (F.col("kinds") == 0), F.col("kinds")).otherwise(F.greatest(F.lit(1), before))
    out = out.withColumn("open_kinds", k)
    ranks = {
        t: sum((F.coalesce(F.col(f"{o}.arrival") < F.col(f"{t}.arrival"), F.lit(False)).cast("int") for o in TERMINAL if o != t), F.lit(0))
        for t in TERMINAL
    }
    return out.select(
        "*",
        *((F.col(t).isNotNull() & (ranks[t] < F.col("open_kinds"))).alias(f"open_{t}") for t in TERMINAL),
        F.coalesce(*(F.when(F.col(t).isNotNull() & (ranks[t] == 0), F.lit(t)) for t in TERMINAL)).alias("first_kind"),
    )


COUNTS = [
    "records_read", "published", "processed", "failed", "dropped", "terminal", "missing_terminal", "retry_attempts",
    "duplicate_published", "duplicate_processed", "duplicate_failed", "duplicate_dropped",
    "processed_without_publish", "failed_without_publish", "dropped_without_publish", "conflicting_terminal_outcomes",
]


def key_counts(keys: DataFrame) -> DataFrame:
    """A key's share in each of COUNTS."""
    ok = valid_key()
    one = lambda c: F.when(ok & c, 1).otherwise(0)
    present = {name: F.col(t).isNotNull() for t, name in KINDS.items()}
    spare = F.col("kinds") - F.col("open_kinds")
    values = {
        "records_read": sum((F.col(f"n_{k}") for k in KINDS), F.col("n_R")),
        "terminal": one(F.col("kinds") > 0),
        "missing_terminal": one(present["published"] & (F.col("kinds") == 0)),
        "retry_attempts": F.col("n_R"),
        "conflicting_terminal_outcomes": F.when(ok, (F.col("open_kinds") >= 2).cast("int") + spare).otherwise(0),
    }
    for t, name in KINDS.items():
        values[name] = one(present[name])
        values[f"duplicate_{name}"] = F.when(ok, F.greatest(F.col(f"n_{t}") - 1, F.lit(0))).otherwise(0)
        if t != "P":
            values[f"{name}_without_publish"] = one(present[name] & F.col("P").isNull())
    return keys.select("topic_id", *(values[c].cast("bigint").alias(c) for c in COUNTS))


def audit_counts(records: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """COUNTS for each topic with a name (topic_id) and in total (topic_id null)."""
    shares = key_counts(keys if keys is not None else lifecycle(records))
    by_topic = shares.groupBy("topic_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return _with_totals(by_topic, COUNTS)


def _with_totals(by_topic: DataFrame, sums: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Rows of a topic and, with a null topic_id, of all: a grouping set over sums of a few rows.

    Topics without a name count in the totals alone.
    """
    both = by_topic.withColumn("topics", F.array(F.lit(None).cast("int"), "topic_id")).select(
        F.explode("topics").alias("topic_id"), *more, *sums
    )
    named = both.where("topic_id is null or topic_id in (1, 2, 3)")
    return named.groupBy("topic_id", *more).agg(*(F.sum(c).cast("bigint").alias(c) for c in sums))


def drops_by_reason(keys: DataFrame) -> DataFrame:
    """topic_id (null: all), reason, drops: the reason of a key's first drop; `unknown` without one."""
    found = keys.where(valid_key() & F.col("D").isNotNull()).withColumn(
        "reason", F.coalesce(F.nullif(F.col("D.drop_reason"), F.lit("")), F.lit("unknown"))
    )
    by_topic = found.groupBy("topic_id", "reason").agg(F.count("*").alias("drops"))
    return _with_totals(by_topic, ["drops"], ["reason"])


# --- ordering


def ordering_input(keys: DataFrame) -> DataFrame:
    """The first outcome of each key, where it is processed or failed."""
    found = keys.where(valid_key() & F.col("first_kind").isin("C", "F"))
    first = F.when(F.col("first_kind") == "C", F.col("C")).otherwise(F.col("F"))
    return found.select(*KEY, first["message_key"].alias("message_key"), first["arrival"].alias("arrival"), first["audit_ts_ms"].alias("audit_ts_ms"), "first_kind")


def out_of_order(outcomes: DataFrame, group: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """group and out_of_order, processed, failed: outcomes below an offset that came earlier in the group.

    chunk: see scans.prefix(); a span of arrival, so that a partition's outcomes are many tasks' work.
    """
    seen = prefix(outcomes, "highest", F.col("offset"), group, ["arrival"], "max", chunk)
    late = F.coalesce(F.col("offset") < F.col("highest"), F.lit(False))
    return seen.groupBy(*group).agg(
        F.count_if(late).alias("out_of_order"),
        F.count_if(late & (F.col("first_kind") == "C")).alias("processed"),
        F.count_if(late & (F.col("first_kind") == "F")).alias("failed"),
    )


BY_PARTITION = ["topic_id", "partition"]
BY_KEY = ["topic_id", "partition", "message_key"]


def ordering_counts(keys: DataFrame, group: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """topic_id (null: all) and its out-of-order counts."""
    by_topic = out_of_order(ordering_input(keys), group, chunk).groupBy("topic_id").agg(
        *(F.sum(c).alias(c) for c in ("out_of_order", "processed", "failed"))
    )
    return _with_totals(by_topic, ["out_of_order", "processed", "failed"])


# --- latency


def latency_sla(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """For each rule (schemas.LATENCY_RULE), in total (topic_id null) and for each of its topics.

    Exceeding is strict. A negative latency and an outcome without publish are unmeasured. PASS if
    100 * exceeded <= measured * allowed, in exact decimals. The rules are a document's few rows; Spark
    broadcasts them by its own check.
    """
    scoped = rules.select("id", "max_ms", F.explode("topic_ids").alias("topic_id"))
    done = keys.where(valid_key() & F.col("open_C")).join(scoped, "topic_id")
    latency = F.col("C.audit_ts_ms") - F.col("P.kafka_ts_ms")
    measured = latency >= 0
    by_topic = done.groupBy("id", "topic_id").agg(
        F.count("*").alias("processed"),
        F.count_if(measured).alias("measured"),
        F.count_if(measured & (latency > F.col("max_ms"))).alias("exceeded"),
        F.count_if(latency < 0).alias("invalid_negative_latency"),
        F.max(F.when(measured, latency)).alias("max_observed_ms"),
    )
    counts = ["processed", "measured", "exceeded", "invalid_negative_latency"]
    both = by_topic.select("id", F.explode(F.array(F.lit(None).cast("int"), "topic_id")).alias("topic_id"), *counts, "max_observed_ms")
    summed = both.groupBy("id", "topic_id").agg(*(F.sum(c).alias(c) for c in counts), F.max("max_observed_ms").alias("max_observed_ms"))
    scopes = rules.select(
        *[c for c in rules.columns if c != "topic_ids"], F.explode(F.concat(F.array(F.lit(None).cast("int")), "topic_ids")).alias("topic_id")
    )
    joined = scopes.alias("s").join(summed.alias("m"), (F.col("s.id") == F.col("m.id")) & F.col("s.topic_id").eqNullSafe(F.col("m.topic_id")), "left")
    joined = joined.select("s.*", *(F.coalesce(f"m.{c}", F.lit(0)).cast("bigint").alias(c) for c in counts), "m.max_observed_ms")
    unmeasured = F.col("processed") - F.col("measured")
    within = (F.col("exceeded") * 100).cast("decimal(38,10)") <= F.col("measured").cast("decimal(20,0)") * F.col("allowed_exceed_percent")
    status = (
        F.when(F.col("processed") == 0, "NOT_EVALUATED")
        .when(unmeasured > 0, "INCOMPLETE")
        .when(within, "PASS")
        .otherwise("FAIL")
    )
    return joined.select(
        "id", "title", "topics", "topic_id", "max_ms", F.col("allowed_exceed_percent").cast("double").alias("allowed_exceed_percent"),
        "processed", "measured", unmeasured.alias("unmeasured"), (F.col("measured") - F.col("exceeded")).alias("within_sla"), "exceeded",
        round6(F.when(F.col("measured") > 0, 100 * F.col("exceeded") / F.col("measured"))).alias("exceeded_percent"),
        "max_observed_ms", "invalid_negative_latency", status.alias("status"),
    )


# --- fairness and freshness between the keys of a topic


def record_age(keys: DataFrame, topic_id: int = TELEMETRY_TOPIC) -> DataFrame:
    """outcome, count, avg_ms, min_ms, max_ms: age from publish to outcome when the key closed, 0 at least."""
    done = keys.where(valid_key() & (F.col("topic_id") == topic_id) & F.col("P").isNotNull() & (F.col("kinds") > 0))
    kind = F.when(F.col("open_C"), "C").when(F.col("open_F"), "F").otherwise("D")
    at = F.when(F.col("open_C"), F.col("C.audit_ts_ms")).when(F.col("open_F"), F.col("F.audit_ts_ms")).otherwise(F.col("D.audit_ts_ms"))
    aged = done.select(kind.alias("kind"), F.greatest(at - F.col("P.kafka_ts_ms"), F.lit(0)).alias("age")).where("age is not null")
    name = F.coalesce(*(F.when(F.col("kind") == t, n) for t, n in TERMINAL.items()))
    return aged.groupBy(name.alias("outcome")).agg(*age_stats(F.col("age")))


def open_outcomes(keys: DataFrame, topic_id: int = TELEMETRY_TOPIC) -> DataFrame:
    """One row for each open outcome of the topic: kind, message_key, arrival, audit_ts_ms."""
    found = F.array_compact(F.array(*(F.when(F.col(f"open_{t}"), F.struct(F.lit(t).alias("kind"), f"{t}.message_key", f"{t}.arrival", f"{t}.audit_ts_ms")) for t in TERMINAL)))
    rows = keys.where(valid_key() & (F.col("topic_id") == topic_id)).select(F.explode(found).alias("o"))
    return rows.select("o.kind", "o.message_key", "o.arrival", "o.audit_ts_ms")


def processed_gaps(keys: DataFrame, watermark: DataFrame, topic_id: int = TELEMETRY_TOPIC, chunk: Column | None = None) -> DataFrame:
    """message_key, max_gap_ms: the longest time without a processed record, up to the topic's watermark.

    watermark: one row with watermark_ms. Gaps go by arrival and may be negative.
    """
    done = open_outcomes(keys, topic_id).where("kind = 'C'")
    lagged = previous(done, "before_ms", F.col("audit_ts_ms"), ["message_key"], ["arrival"], chunk)
    gaps = lagged.groupBy("message_key").agg(
        F.max(F.col("audit_ts_ms") - F.col("before_ms")).alias("between"),
        F.max(F.struct("arrival", "audit_ts_ms")).alias("last"),
    )
    trailing = F.col("watermark_ms") - F.col("last.audit_ts_ms")
    return gaps.crossJoin(watermark.limit(1)).select("message_key", F.greatest("between", trailing).alias("max_gap_ms"))


def watermark(records: DataFrame, topic_id: int | None = TELEMETRY_TOPIC) -> DataFrame:
    """One row, watermark_ms: the largest audit time read, 0 at least."""
    rows = records if topic_id is None else records.where(F.col("topic_id") == topic_id)
    return rows.agg(F.greatest(F.coalesce(F.max("audit_ts_ms"), F.lit(0)), F.lit(0)).cast("bigint").alias("watermark_ms"))


def key_outcomes(keys: DataFrame, topic_id: int = TELEMETRY_TOPIC) -> DataFrame:
    """message_key, published, processed, failed, dropped: unique publishes and open outcomes."""
    mine = keys.where(valid_key() & (F.col("topic_id") == topic_id))
    entry = lambda t, cond: F.when(cond, F.struct(F.lit(t).alias("kind"), f"{t}.message_key"))
    entries = F.array_compact(F.array(entry("P", F.col("P").isNotNull()), *(entry(t, F.col(f"open_{t}")) for t in TERMINAL)))
    rows = mine.select(F.explode(entries).alias("e")).select("e.kind", "e.message_key")
    return rows.groupBy("message_key").agg(*(F.count_if(F.col("kind") == t).alias(n) for t, n in KINDS.items()))


def key_fairness(outcomes: DataFrame, gaps: DataFrame) -> DataFrame:
    """metric and stats.SUMMARY over the keys: publishes, outcomes, ratios and longest gaps."""
    values = {
        "published_per_key": F.col("published"),
        "processed_per_key": F.col("processed"),
        "dropped_per_key": F.col("dropped"),
        "processed_ratio": ratio("processed", "published"),
        "dropped_ratio": ratio("dropped", "published"),
    }
    rows = long_form(outcomes, values).unionByName(long_form(gaps, {"processed_max_gap_ms": F.col("max_gap_ms")}))
    return distribution(rows, "value", ["metric"])


def gap_thresholds(gaps: DataFrame) -> DataFrame:
    """keys_over_1s, 5s, 10s and 30s."""
    return gaps.agg(*(F.count_if(F.col("max_gap_ms") > 1000 * s).alias(f"keys_over_{s}s") for s in (1, 5, 10, 30)))


def drop_islands(keys: DataFrame, topic_id: int = TELEMETRY_TOPIC, chunk: Column | None = None) -> DataFrame:
    """message_key, island, dropped, first_drop_ms, last_drop_ms, processed_ms.

    An island is the drops of a key since its last processed record, with the processed record that
    ends it; processed_ms is null for the drops that are still pending.
    """
    rows = open_outcomes(keys, topic_id).where("kind in ('C', 'D')")
    rows = prefix(rows, "island", (F.col("kind") == "C").cast("bigint"), ["message_key"], ["arrival"], "sum", chunk)
    dropped = F.col("kind") == "D"
    stamp = F.when(dropped, F.struct("arrival", "audit_ts_ms"))
    return rows.groupBy("message_key", F.coalesce("island", F.lit(0)).alias("island")).agg(
        F.count_if(dropped).alias("dropped"),
        F.min(stamp)["audit_ts_ms"].alias("first_drop_ms"),
        F.max(stamp)["audit_ts_ms"].alias("last_drop_ms"),
        F.max(F.when(~dropped, F.col("audit_ts_ms"))).alias("processed_ms"),
    )


def freshness_histogram(islands: DataFrame) -> DataFrame:
    """dropped, n: processed records by how many drops of their key came since the one before."""
    return histogram(islands.where("processed_ms is not null"), "dropped")


def freshness_summary(islands: DataFrame) -> DataFrame:
    """One row: processed records, pending keys and drops, and times from drops to the processed record."""
    done, pending = F.col("processed_ms").isNotNull(), F.col("processed_ms").isNull() & (F.col("dropped") > 0)
    wait = lambda c: F.when(done, F.greatest(F.col("processed_ms") - F.col(c), F.lit(0)))
    first, last = (F.when(F.col("dropped") > 0, wait(c)) for c in ("first_drop_ms", "last_drop_ms"))
    return islands.agg(
        F.count_if(done).alias("processed_records"),
        F.count_if(pending).alias("keys_with_pending_drops"),
        F.coalesce(F.sum(F.when(pending, F.col("dropped"))), F.lit(0)).cast("bigint").alias("pending_dropped_records"),
        *age_stats(first, "first_drop_to_processed_"),
        *age_stats(last, "last_drop_to_processed_"),
    )


# --- matching with a bounded time to live


def bounded_lifecycle(records: DataFrame, ttl_ms: int, chunk: Column | None = None) -> DataFrame:
    """lifecycle() by (key, session): a key not touched for ttl_ms, by the watermark, is forgotten.

    The watermark at a record is the largest audit time so far of its topic. A key whose last touch is
    older than watermark - ttl_ms when a record of it comes starts again: its publish is missing, a
    late outcome is without publish. Eviction is immediate; nothing depends on when a sweep runs.
    """
    if ttl_ms <= 0:
        raise ValueError("ttl_ms must be positive")
    rows = prefix(records, "_before", F.col("audit_ts_ms"), ["topic_id"], ["arrival"], "max", chunk)
    rows = rows.withColumn("_now", F.greatest("audit_ts_ms", "_before")).drop("_before")
    touch = F.when(F.col("record_type") != "R", F.col("audit_ts_ms"))
    rows = previous(rows, "_touched", touch, KEY, ["arrival"])
    fresh = valid_key() & (F.col("record_type") != "R") & (F.col("_now") - ttl_ms > F.col("_touched"))
    rows = prefix(rows, "_earlier", fresh.cast("bigint"), KEY, ["arrival"], "sum")
    session = (F.coalesce("_earlier", F.lit(0)) + F.coalesce(fresh.cast("bigint"), F.lit(0))).alias("session")
    return lifecycle(rows.select(*records.columns, session), ["session"])


# --- the whole summary


def summary(records: DataFrame, rules: DataFrame | None = None, ttl_ms: int | None = None, metadata: dict | None = None) -> dict:
    """The summary document, as nested dicts: totals and topics, and fairness of the telemetry topic.

    What comes to the driver are aggregates: a few rows a topic, and of the histogram of drops a row
    for each distinct number.
    """
    keys = lifecycle(records) if ttl_ms is None else bounded_lifecycle(records, ttl_ms)
    names = {None: None} | {k: v for k, v in ((1, "order.events.v1"), (2, "batch.events.v1"), (3, "cauldron.events.v1"))}
    counts = {r["topic_id"]: r for r in audit_counts(records, keys).collect()}
    reasons: dict = {}
    for r in drops_by_reason(keys).orderBy("reason").collect():
        reasons.setdefault(r["topic_id"], {})[r["reason"]] = r["drops"]
    orders = {n: {r["topic_id"]: r for r in ordering_counts(keys, g).collect()} for n, g in (("by_partition", BY_PARTITION), ("by_key", BY_KEY))}
    slas: dict = {}
    if rules is not None:
        for r in latency_sla(keys, rules).collect():
            slas.setdefault(r["topic_id"], []).append({k: v for k, v in r.asDict().items() if k != "topic_id"})
    sections = {}
    for topic_id, name in names.items():
        c = counts[topic_id].asDict() if topic_id in counts else dict.fromkeys(COUNTS, 0)
        part: dict = {} if topic_id is None else {"topic_id": topic_id}
        part |= {n: c[n] for n in ("published", "processed", "failed", "dropped")}
        part |= {"dropped_by_reason": reasons.get(topic_id, {}), "retry_attempts": c["retry_attempts"], "terminal": c["terminal"], "missing_terminal": c["missing_terminal"]}
        part["duplicates"] = {n: c[f"duplicate_{n}"] for n in KINDS.values()}
        part["without_publish"] = {n: c[f"{n}_without_publish"] for n in TERMINAL.values()}
        part["conflicting_terminal_outcomes"] = c["conflicting_terminal_outcomes"]
        part["ordering"] = {
            n: {k: (rows[topic_id][k] if topic_id in rows else 0) for k in ("out_of_order", "processed", "failed")} for n, rows in orders.items()
        }
        if topic_id == TELEMETRY_TOPIC:
            part["key_fairness"] = fairness_section(keys, records)
        if topic_id in slas:
            part["latency_sla"] = {"rules": slas[topic_id]}
        sections[name] = part
    total = counts[None]["records_read"] if None in counts else 0
    matching = {"mode": "exact" if ttl_ms is None else "bounded_ttl", "open_record_ttl_seconds": None if ttl_ms is None else round(ttl_ms / 1000, 3)}
    audit = {"records_read": total, "delivery_matching": matching, "totals": sections.pop(None), "topics": sections}
    return {"test": metadata, "audit": audit} if metadata else {"audit": audit}


def fairness_section(keys: DataFrame, records: DataFrame) -> dict:
    outcomes = key_outcomes(keys)
    gaps = processed_gaps(keys, watermark(records))
    found = {r["metric"]: {k: v for k, v in r.asDict().items() if k != "metric"} for r in key_fairness(outcomes, gaps).collect()}
    totals = outcomes.agg(F.count("*").alias("keys"), F.count_if(F.col("processed") == 0).alias("none")).first()
    islands = drop_islands(keys)
    bins = {r["dropped"]: r["n"] for r in freshness_histogram(islands).orderBy("dropped").collect()}
    spread = distribution(islands.where("processed_ms is not null"), "dropped").collect()
    gap = freshness_summary(islands).first().asDict()
    ages = {r["outcome"]: {k: v for k, v in r.asDict().items() if k != "outcome"} for r in record_age(keys).collect()}
    none = dict.fromkeys(("count", "avg", "min", "p50", "p95", "p99", "max", "coefficient_of_variation", "gini", "max_to_min"))
    no_age = {"count": 0, "avg_ms": None, "min_ms": None, "max_ms": None}
    pick = lambda p: {k: gap[f"{p}_{k}"] for k in ("count", "avg_ms", "min_ms", "max_ms")}
    metrics = ("published_per_key", "processed_per_key", "dropped_per_key", "processed_ratio", "dropped_ratio")
    return {
        "keys": totals["keys"],
        "keys_without_processed": totals["none"],
        **{m: found.get(m, none) for m in metrics},
        "processed_max_gap_ms": found.get("processed_max_gap_ms", none) | gap_thresholds(gaps).first().asDict(),
        "freshness_gap": {
            "processed_records": gap["processed_records"],
            "dropped_before_processed": spread[0].asDict() if spread else none,
            "dropped_before_processed_histogram": bins,
            "first_drop_to_processed_ms": pick("first_drop_to_processed"),
            "last_drop_to_processed_ms": pick("last_drop_to_processed"),
            "keys_with_pending_drops": gap["keys_with_pending_drops"],
            "pending_dropped_records": gap["pending_dropped_records"],
        },
        "record_age": {n: ages.get(n, no_age) for n in ("processed", "dropped", "failed")},
    }


def named(counts: DataFrame) -> DataFrame:
    """topic_id as a name: `all` for the totals."""
    return counts.withColumn("topic", F.when(F.col("topic_id").isNull(), F.lit("all")).otherwise(topic_name_of("topic_id"))).drop("topic_id")


