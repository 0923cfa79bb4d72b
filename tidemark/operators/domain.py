"""Folding lifecycle events into entity state, and enriching telemetry.

Events have `arrival` (orderable, unique): "last" is by processing, not by event time. A fold is one
aggregation by entity, combined before the shuffle: the last value that is not blank is the maximum of
(arrival, value) over the values that aren't, so no entity's events are ever sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hex_signed, java_abs, java_hash, nonblank, pad_start, parse_instant, round_half_up
from tidemark.functions.scans import previous
from tidemark.functions.stats import age_stats

#: State by event type. Fixed values; other types keep their own name.
BATCH_STATUS = {
    "BATCH_CREATED": "CREATED",
    "BATCH_REAGENTS_PREPARATION_STARTED": "REAGENTS_PREPARING",
    "BATCH_REAGENTS_PREPARED": "REAGENTS_PREPARED",
    "BATCH_CAULDRON_REQUESTED": "WAITING_FOR_CAULDRON",
    "BATCH_CAULDRON_ASSIGNED": "CAULDRON_ASSIGNED",
    "BATCH_BREWING_STARTED": "BREWING",
    "BATCH_BREWING_STEP_COMPLETED": "BREWING",
    "BATCH_BREWING_COMPLETED": "WAITING_FOR_BOTTLING",
    "BATCH_BOTTLING_STARTED": "BOTTLING",
    "BATCH_BOTTLING_COMPLETED": "BOTTLING_COMPLETED",
    "BATCH_FAILED": "FAILED",
    "BATCH_CANCELLED": "CANCELLED",
}
ORDER_STATUS = {
    "ORDER_CREATED": "CREATED",
    "ORDER_FLAVOUR_ANALYSED": "CREATED",
    "ORDER_BATCH_ASSIGNED": "BATCH_ASSIGNED",
    "ORDER_WAITING_FOR_BOTTLING": "WAITING_FOR_BOTTLING",
    "ORDER_COMPLETED": "COMPLETED",
    "ORDER_CANCELLED": "CANCELLED",
    "ORDER_FAILED": "FAILED",
}


def status_of(event_type: Column | str, names: Mapping[str, str]) -> Column:
    c = F.col(event_type) if isinstance(event_type, str) else event_type
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in names.items()), c)


def last_nonblank(c: str) -> Column:
    value = nonblank(c)
    return F.max(F.when(value.isNotNull(), F.struct("arrival", value.alias("v"))))["v"]


def last(c: Column) -> Column:
    return F.max(F.struct("arrival", c.alias("v")))["v"]


def _as_events(state: DataFrame | None, events: DataFrame, columns: list[str]) -> DataFrame:
    """Existing state as rows that come before all events."""
    rows = events.select(*columns, F.struct(F.lit(1).alias("late"), F.col("arrival").alias("at")).alias("arrival"))
    if state is None:
        return rows
    first = F.struct(F.lit(0).alias("late"), F.lit(None).cast(events.schema["arrival"].dataType).alias("at"))
    return state.select(*(F.col(c) for c in columns), first.alias("arrival")).unionByName(rows)


def fold_orders(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """schemas.ORDER_STATE of each order. events: order_id, batch_id, potion_id, recipe_id, customer_id,
    event_type, occurred_at, arrival."""
    ids = ["batch_id", "potion_id", "recipe_id", "customer_id"]
    rows = events.withColumns({"status": status_of("event_type", ORDER_STATUS), "updated_at": F.col("occurred_at")})
    rows = _as_events(state, rows, ["order_id", *ids, "status", "updated_at"])
    folded = rows.groupBy("order_id").agg(
        *(last_nonblank(c).alias(c) for c in ids), last(F.col("status")).alias("status"), last(F.col("updated_at")).alias("updated_at")
    )
    default = {c: F.coalesce(c, F.lit("")) for c in ("potion_id", "customer_id")}
    return folded.withColumns(default).select("order_id", "batch_id", "potion_id", "recipe_id", "customer_id", "status", "updated_at")


def fold_batches(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """schemas.BATCH_STATE of each batch. order_ids: each id once, by its first place in the events.

    Ids are found by (batch, id) first, so what is gathered into an array is a batch's distinct ids.
    """
    ids = ["recipe_id", "potion_id", "cauldron_id"]
    rows = events.withColumns({"status": status_of("event_type", BATCH_STATUS), "updated_at": F.col("occurred_at")})
    rows = _as_events(state, rows, ["batch_id", *ids, "order_ids", "status", "updated_at"])
    folded = rows.groupBy("batch_id").agg(
        *(last_nonblank(c).alias(c) for c in ids), last(F.col("status")).alias("status"), last(F.col("updated_at")).alias("updated_at")
    )
    each = rows.select("batch_id", "arrival", F.posexplode("order_ids").alias("place", "id")).where(nonblank("id").isNotNull())
    firsts = each.groupBy("batch_id", "id").agg(F.min(F.struct("arrival", "place")).alias("first"))
    lists = firsts.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda e: e["id"]).alias("order_ids"))
    out = folded.join(lists, "batch_id", "left").withColumn("order_ids", F.coalesce("order_ids", F.array().cast("array<string>")))
    return out.select("batch_id", "recipe_id", "potion_id", "cauldron_id", "status", "order_ids", "updated_at")


def activations(events: DataFrame) -> DataFrame:
    """cauldron_id, batch_id, arrival of the events that make a batch its cauldron's active one."""
    kinds = ("BATCH_CAULDRON_ASSIGNED", "BATCH_BREWING_STARTED")
    return events.where(F.col("event_type").isin(*kinds) & nonblank("cauldron_id").isNotNull()).select("cauldron_id", "batch_id", "arrival")


def active_batches(events: DataFrame) -> DataFrame:
    """cauldron_id, batch_id: the last batch that was activated. Completion doesn't undo it."""
    return activations(events).groupBy("cauldron_id").agg(last(F.col("batch_id")).alias("batch_id"))


def batch_of_telemetry(telemetry: DataFrame, activated: DataFrame, chunk: Column | None = None) -> DataFrame:
    """telemetry with `batch`: its own batch_id, else its cauldron's active batch at its arrival.

    An as-of join: both sides are stacked and the last activation before a row is a running maximum, in
    two levels where chunk is given. activated: cauldron_id, batch_id, arrival. No match leaves null.
    """
    names = telemetry.columns
    left = telemetry.select(F.col("cauldron_id"), "arrival", F.lit(None).cast("string").alias("active"), F.struct(*names).alias("row"))
    right = activated.select("cauldron_id", "arrival", F.col("batch_id").alias("active"), F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    stacked = left.unionByName(right).where("cauldron_id is not null or row is not null").withColumn("cauldron_id", F.coalesce("cauldron_id", F.lit("")))
    found = previous(stacked, "asof", nonblank("active"), ["cauldron_id"], ["arrival"], chunk).where("row is not null")
    return found.select(*(F.col(f"row.{c}").alias(c) for c in names), F.coalesce(nonblank("row.batch_id"), F.col("asof")).alias("batch"))


def enrich_telemetry(telemetry: DataFrame, activated: DataFrame, batches: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Telemetry whose batch is known, with the batch's recipe_id: rows without one yield nothing."""
    found = batch_of_telemetry(telemetry, activated, chunk).where("batch is not null")
    known = batches.select(F.col("batch_id").alias("batch"), F.col("recipe_id").alias("batch_recipe_id"))
    return found.join(known, "batch")


# --- the models, as expressions


def eta_units(temperature: Column, density: Column) -> Column:
    return F.lit(420.0) + F.abs(temperature - 93.0) * 11.0 + F.abs(density - 1.18) * 160.0


def moon_phase(temperature: Column) -> Column:
    return F.when(temperature >= 90.0, "waxing_gibbous").otherwise("waning_crescent")


def alignment(density: Column) -> Column:
    return F.when(density >= 1.21, "volatile").otherwise("favorable")


def eta_seconds(units: Column, phase: Column, planets: Column, temperature: Column, density: Column) -> Column:
    """Model units calibrated to seconds; 1 at least."""
    lunar = F.when(phase == "waxing_gibbous", 1.08).when(phase == "full_moon", 1.15).when(phase == "waning_crescent", 0.92).otherwise(1.0)
    planetary = F.when(planets == "favorable", 0.97).when(planets == "volatile", 1.12).otherwise(1.0)
    thermal = F.lit(1.0) + F.abs(F.lit(92.0) - temperature) / 250.0
    dense = F.lit(1.0) + F.abs(F.lit(1.15) - density) / 3.0
    return F.greatest(round_half_up(units * lunar * planetary * thermal * dense), F.lit(1).cast("bigint"))


def estimate_eta(telemetry: DataFrame, profile: str = "lunar-calibration-v1") -> DataFrame:
    """telemetry (batch, cauldron_id, temperature_c, density_sg, ...) with the model's and the calibrated ETA."""
    t, d = F.col("temperature_c"), F.col("density_sg")
    out = telemetry.withColumns({"magical_eta_units": eta_units(t, d), "moon_phase": moon_phase(t), "planetary_alignment": alignment(d)})
    return out.withColumns(
        {
            "eta_seconds": eta_seconds(F.col("magical_eta_units"), F.col("moon_phase"), F.col("planetary_alignment"), t, d),
            "normalization_profile": F.lit(profile),
            "regulatory_trace_id": F.concat(F.lit("mrb-"), F.col("batch"), F.lit("-"), F.col("cauldron_id")),
        }
    )


def previous_context(telemetry: DataFrame, chunk: Column | None = None) -> DataFrame:
    """telemetry with previous_*: the readings and model units of the batch's last processed row."""
    now = F.struct("temperature_c", "density_sg", "bubble_rate_hz", "magical_eta_units", "occurred_at")
    out = previous(telemetry, "_context", now, ["batch"], ["arrival"], chunk)
    return out.select(
        *telemetry.columns,
        *(F.col(f"_context.{c}").alias(f"previous_{c}") for c in ("temperature_c", "density_sg", "bubble_rate_hz", "magical_eta_units", "occurred_at")),
    )


def event_gaps(telemetry: DataFrame) -> DataFrame:
    """One row: gaps in event time to the previous processed telemetry, and how many ran backwards.

    telemetry has occurred_at and previous_occurred_at, ISO-8601 strings; what can't be parsed is left out.
    """
    gap = parse_instant("occurred_at") - parse_instant("previous_occurred_at")
    rows = telemetry.select(gap.alias("gap"))
    return rows.agg(*age_stats(F.when(F.col("gap") >= 0, F.col("gap")), "gap_"), F.count_if(F.col("gap") < 0).alias("out_of_order"))


#: Palettes by customer. Fixed values.
PALETTES = ["ember-gold", "moonlit-teal", "violet-smoke", "moss-and-silver"]


def flavour(orders: DataFrame) -> DataFrame:
    """schemas.FLAVOUR_STATE (without model_request_id, which is random) of created orders.

    orders: order_id, customer_id, occurred_at.
    """
    customer, order = java_abs(java_hash("customer_id")), java_abs(java_hash("order_id"))
    slot = customer % 4
    palette = F.coalesce(*(F.when(slot == k, F.lit(p)) for k, p in enumerate(PALETTES[:3])), F.lit(PALETTES[3]))
    digit = F.substring(F.col("occurred_at"), -2, 1).rlike(r"^\p{Nd}$")
    return orders.select(
        "order_id",
        F.concat(F.lit("flavour-"), hex_signed(customer)).alias("flavour_profile_id"),
        palette.alias("palette"),
        (F.lit(0.92) + (order % 18) / 100.0).alias("eta_correction_factor"),
        F.when(digit, "full_moon").otherwise("waxing_gibbous").alias("moon_phase"),
        F.col("occurred_at").alias("updated_at"),
    )


def receipts(steps: DataFrame) -> DataFrame:
    """schemas.RECEIPT (without accepted_at, the registry's clock) of completed brewing steps.

    steps: batch_id, cauldron_id, step_number, step_code, regulatory_trace_id, occurred_at.
    """
    shard = (java_abs(java_hash("batch_id")) % 8 + 1).cast("string")
    trace = hex_signed(java_abs(java_hash("regulatory_trace_id")))
    return steps.select(
        "batch_id",
        "cauldron_id",
        "step_number",
        "step_code",
        F.concat(F.lit("acr-"), "batch_id", F.lit("-"), F.col("step_number").cast("string"), F.lit("-"), trace).alias("receipt_id"),
        F.concat(F.lit("acr-shard-"), pad_start(shard, 2)).alias("registry_shard"),
        "regulatory_trace_id",
        F.col("occurred_at").alias("updated_at"),
    )


def conditional_enrichment(events: DataFrame) -> DataFrame:
    """events with `flavour_profile_id`, of ORDER_CREATED alone: others never reach the model."""
    customer = java_abs(java_hash("customer_id"))
    return events.withColumn(
        "flavour_profile_id", F.when(F.col("event_type") == "ORDER_CREATED", F.concat(F.lit("flavour-"), hex_signed(customer)))
    )


def order_tracking(orders: DataFrame, batches: DataFrame, flavours: DataFrame) -> DataFrame:
    """Each order with its batch and flavour, where there are any."""
    batch = batches.select(F.col("batch_id").alias("_batch"), F.struct(*batches.columns).alias("batch"))
    taste = flavours.select("order_id", F.struct(*flavours.columns).alias("flavour"))
    return orders.join(batch, orders["batch_id"] == F.col("_batch"), "left").drop("_batch").join(taste, "order_id", "left")


def batch_completion(orders_done: DataFrame, sizes: DataFrame) -> DataFrame:
    """batch_id, n_orders, completed of the batches all of whose orders are completed."""
    done = orders_done.groupBy("batch_id").agg(F.count_distinct("order_id").alias("completed"))
    return sizes.join(done, "batch_id").where(F.col("completed") >= F.col("n_orders")).select("batch_id", "n_orders", "completed")


#: Key families of the state store. Fixed values.
STATE_KEYS = {
    "order": "order-state",
    "batch": "batch-state",
    "active_batch": "cauldron-active-batch",
    "eta_context": "eta-context",
    "flavour": "order-flavour",
    "receipt": "brewing-step-receipt",
}


def state_key(family: str, *ids: str) -> Column:
    return F.concat_ws(":", F.lit(STATE_KEYS[family]), *(F.col(c).cast("string") for c in ids))
