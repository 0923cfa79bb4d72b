"""Entity folds, as-of joins and model expressions, on lifecycle events derived from orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import iso_instant
from tidemark.operators import domain
from tidemark.sources import derived, generator

from .common import plain


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def order_events(orders: DataFrame) -> DataFrame:
    """One to four events an order; blanks stand for what an event doesn't know."""
    key, blank = F.col("o_orderkey"), F.lit("")
    name = F.concat(F.lit("o-"), key.cast("string"))
    batch = F.concat(F.lit("b-"), F.expr("o_orderkey div 4").cast("string"))

    def event(step: int, kind: str, b: Column, potion: Column, recipe: Column, customer: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), b.alias("batch_id"), potion.alias("potion_id"), recipe.alias("recipe_id"), customer.alias("customer_id"),
            (key * 10 + step).alias("arrival"),
        )

    potion = F.concat(F.lit("potion-"), (F.col("o_custkey") % 3).cast("string"))
    recipe = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("recipe-"), (key % 7).cast("string")))
    customer = F.concat(F.lit("c-"), F.col("o_custkey").cast("string"))
    status = F.col("o_orderstatus")
    made = F.array_compact(
        F.array(
            event(1, "ORDER_CREATED", blank, potion, recipe, customer),
            F.when(status.isin("P", "F"), event(2, "ORDER_BATCH_ASSIGNED", batch, blank, F.lit(" "), blank)),
            F.when((status == "F") & (key % 3 != 0), event(3, "ORDER_COMPLETED", batch, blank, blank, blank)),
            F.when((status == "P") & (key % 11 == 0), event(4, "ORDER_CANCELLED", blank, blank, blank, blank)),
            F.when((status == "P") & (key % 13 == 0), event(5, "ORDER_REOPENED", blank, blank, F.lit("recipe-x"), blank)),
        )
    )
    at = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = orders.select(name.alias("order_id"), at.alias("occurred_at"), F.explode(made).alias("e"))
    return rows.select("order_id", "occurred_at", "e.*")


def batch_events(orders: DataFrame) -> DataFrame:
    """An event an order: its batch of four orders goes through four stages and repeats ids."""
    key = F.col("o_orderkey")
    number = F.expr("o_orderkey div 4")
    stage = key % 4
    kind = (
        F.when(stage == 0, "BATCH_CREATED").when(stage == 1, "BATCH_CAULDRON_ASSIGNED").when(stage == 2, "BATCH_BREWING_STARTED")
        .when(key % 3 == 0, "BATCH_BREWING_COMPLETED").otherwise("BATCH_PAUSED")
    )
    name = F.concat(F.lit("o-"), key.cast("string"))
    cauldron = F.when((stage == 1) | ((stage == 2) & (number % 5 != 0)), F.concat(F.lit("cauldron-"), (number % 50).cast("string"))).otherwise("")
    return orders.select(
        F.concat(F.lit("b-"), number.cast("string")).alias("batch_id"),
        F.when(stage == 0, F.concat(F.lit("recipe-"), (number % 7).cast("string"))).otherwise("").alias("recipe_id"),
        F.when(stage == 3, "").otherwise(F.concat(F.lit("potion-"), (F.col("o_custkey") % 3).cast("string"))).alias("potion_id"),
        cauldron.alias("cauldron_id"),
        F.array(name, F.lit(""), F.concat(F.lit("o-"), (key - 1).cast("string")), name).alias("order_ids"),
        kind.alias("event_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("occurred_at"),
        (key * 10).alias("arrival"),
    )


def telemetry(events: DataFrame) -> DataFrame:
    rows = derived.log(events)
    user = F.col("message_key").cast("bigint")
    return rows.select(
        (F.col("event_id") * 15 + 7).alias("arrival"),
        F.concat(F.lit("cauldron-"), (user % 50).cast("string")).alias("cauldron_id"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("b-"), (F.col("event_id") % 1000).cast("string"))).otherwise("").alias("batch_id"),
        (F.lit(80.0) + (F.col("event_id") % 200) / 10.0).alias("temperature_c"),
        (F.lit(1.1) + (F.col("event_id") % 30) / 200.0).alias("density_sg"),
        (F.lit(7.0) + (F.col("event_id") % 10) / 10.0).alias("bubble_rate_hz"),
        F.when(F.col("event_id") % 101 == 0, "soon").otherwise(iso_instant(F.col("kafka_ts_ms") - F.when(F.col("event_id") % 9 == 0, 3_600_000).otherwise(0))).alias("occurred_at"),
    )


def order_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(domain.fold_orders(order_events(_orders(spark, sf_dir))))


def batch_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = domain.fold_batches(batch_events(_orders(spark, sf_dir)))
    return plain(out.withColumn("order_ids", F.concat_ws(",", "order_ids")))


def fold_onto_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold in two halves, the second onto the first's state: the same as at once."""
    events = order_events(_orders(spark, sf_dir))
    first = domain.fold_orders(events.where("arrival % 10 < 3"))
    return plain(domain.fold_orders(events.where("arrival % 10 >= 3"), first))


def active_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(domain.active_batches(batch_events(_orders(spark, sf_dir))))


CHUNK = "arrival div 100000"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = batch_events(_orders(spark, sf_dir))
    return domain.enrich_telemetry(telemetry(derived.events(spark, sf_dir)), domain.activations(events), domain.fold_batches(events), F.expr(CHUNK))


def active_batch_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = domain.activations(batch_events(_orders(spark, sf_dir)))
    out = domain.batch_of_telemetry(telemetry(derived.events(spark, sf_dir)), active, F.expr(CHUNK))
    return plain(out.select("arrival", "cauldron_id", "batch"))


def telemetry_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_found(spark, sf_dir).select("arrival", "cauldron_id", "batch", "batch_recipe_id", "temperature_c"))


def eta_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = domain.previous_context(domain.estimate_eta(_found(spark, sf_dir)), F.expr(CHUNK))
    return plain(
        out.select(
            "arrival", "batch", F.round("magical_eta_units", 6).alias("magical_eta_units"), "moon_phase", "planetary_alignment", "eta_seconds",
            "regulatory_trace_id", F.round("previous_temperature_c", 6).alias("previous_temperature_c"),
            F.round("previous_magical_eta_units", 6).alias("previous_magical_eta_units"),
        )
    )


def event_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(domain.event_gaps(domain.previous_context(domain.estimate_eta(_found(spark, sf_dir)), F.expr(CHUNK))))


def order_tracking_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    created = order_events(orders).where("event_type = 'ORDER_CREATED' and arrival % 3 = 0")
    out = domain.order_tracking(domain.fold_orders(order_events(orders)), domain.fold_batches(batch_events(orders)), domain.flavour(created))
    return plain(
        out.select("order_id", "status", "batch_id", F.col("batch.status").alias("batch_status"), F.col("batch.cauldron_id").alias("cauldron_id"),
                   F.col("flavour.palette").alias("palette"))
    )


def flavour_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = order_events(_orders(spark, sf_dir)).where("event_type = 'ORDER_CREATED'")
    out = domain.flavour(created)
    return plain(out.withColumn("eta_correction_factor", F.round("eta_correction_factor", 6)))


def conditional_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = domain.conditional_enrichment(order_events(_orders(spark, sf_dir)))
    return plain(out.select("arrival", "event_type", "flavour_profile_id"))


def brewing_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _orders(spark, sf_dir).select(
        F.concat(F.lit("b-"), F.expr("o_orderkey div 4").cast("string")).alias("batch_id"),
        F.lit("cauldron-1").alias("cauldron_id"),
        (F.col("o_orderkey") % 4 + 1).alias("step_number"),
        F.lit("SETTLE").alias("step_code"),
        F.concat(F.lit("mrb-é-"), F.col("o_orderkey").cast("string")).alias("regulatory_trace_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("occurred_at"),
    )
    return plain(domain.receipts(steps).select("batch_id", "step_number", "receipt_id", "registry_shard"))


def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = order_events(_orders(spark, sf_dir)).where("event_type = 'ORDER_COMPLETED'")
    sizes = batch_events(_orders(spark, sf_dir)).groupBy("batch_id").agg(F.count("*").alias("n_orders"))
    # a batch whose id is a multiple of 3 needs two orders only
    sizes = sizes.withColumn("n_orders", F.when(F.substring("batch_id", 3, 20).cast("bigint") % 3 == 0, 2).otherwise(F.col("n_orders")).cast("bigint"))
    return plain(domain.batch_completion(done, sizes))


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four orders as a script's entities."""
    orders = _orders(spark, sf_dir)
    entry = F.struct(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("order_id"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("customer_id"),
                     (F.col("o_orderkey") * 1000).alias("created_ms"))
    grouped = orders.groupBy(F.expr("o_orderkey div 4").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), entry.alias("e")))).alias("es"))
    potion, recipe = generator.recipe_of(F.col("n"))
    return grouped.select(
        F.concat(F.lit("b-"), F.col("n").cast("string")).alias("batch_id"), potion.alias("potion_id"), recipe.alias("recipe_id"),
        F.concat(F.lit("cauldron-"), (F.col("n") % 8).cast("string")).alias("cauldron_id"), (F.col("n") * 60_000).alias("started_ms"),
        F.lit(120_000).alias("brew_ms"), F.transform("es", lambda e: e["e"]).alias("orders"),
    )


def lifecycle_event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = _script(spark, sf_dir)
    orders = generator.scripted_order_events(script).select(F.lit("order").alias("stream"), F.col("order_id").alias("key"), "batch_id", "event_type", "occurred_ms")
    batches = generator.scripted_batch_events(script).select(F.lit("batch").alias("stream"), F.col("batch_id").alias("key"), "batch_id", "event_type", "occurred_ms")
    return plain(orders.unionByName(batches))


def fleet_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = derived.events(spark, sf_dir).select(F.col("event_id").alias("sequence"), F.col("event_id").alias("occurred_ms"))
    units = generator.fleet(spark, 32)
    readings = generator.telemetry_row(F.col("sequence") % 300, 16)
    out = generator.fleet_telemetry(ticks, units, 32, 0).select("sequence", "cauldron_id", "batch_id")
    return plain(
        out.select("sequence", "cauldron_id", "batch_id", *(F.round(readings[c], 6).alias(c) for c in ("temperature_c", "fuel_level_pct", "soot_index")),
                   F.lower(F.hex(readings["diagnostics_blob"])).alias("blob"))
    )


_ORDER_EVENTS = """
base AS (
  SELECT o_orderkey AS k, 'o-' || o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS occurred_at, o_orderstatus AS s,
    'b-' || (o_orderkey // 4) AS batch, 'potion-' || (o_custkey % 3) AS potion, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'recipe-' || (o_orderkey % 7) END AS recipe,
    'c-' || o_custkey AS customer
  FROM orders
),
oe AS (
  SELECT order_id, occurred_at, 'ORDER_CREATED' AS event_type, NULL AS batch_id, potion AS potion_id, recipe AS recipe_id, customer AS customer_id, k * 10 + 1 AS arrival FROM base
  UNION ALL SELECT order_id, occurred_at, 'ORDER_BATCH_ASSIGNED', batch, NULL, NULL, NULL, k * 10 + 2 FROM base WHERE s IN ('P', 'F')
  UNION ALL SELECT order_id, occurred_at, 'ORDER_COMPLETED', batch, NULL, NULL, NULL, k * 10 + 3 FROM base WHERE s = 'F' AND k % 3 <> 0
  UNION ALL SELECT order_id, occurred_at, 'ORDER_CANCELLED', NULL, NULL, NULL, NULL, k * 10 + 4 FROM base WHERE s = 'P' AND k % 11 = 0
  UNION ALL SELECT order_id, occurred_at, 'ORDER_REOPENED', NULL, NULL, 'recipe-x', NULL, k * 10 + 5 FROM base WHERE s = 'P' AND k % 13 = 0
),
order_state AS (
  SELECT order_id, arg_max(batch_id, arrival) FILTER (batch_id IS NOT NULL) AS batch_id, coalesce(arg_max(potion_id, arrival) FILTER (potion_id IS NOT NULL), '') AS potion_id,
    arg_max(recipe_id, arrival) FILTER (recipe_id IS NOT NULL) AS recipe_id, coalesce(arg_max(customer_id, arrival) FILTER (customer_id IS NOT NULL), '') AS customer_id,
    CASE arg_max(event_type, arrival) WHEN 'ORDER_CREATED' THEN 'CREATED' WHEN 'ORDER_BATCH_ASSIGNED' THEN 'BATCH_ASSIGNED' WHEN 'ORDER_COMPLETED' THEN 'COMPLETED'
      WHEN 'ORDER_CANCELLED' THEN 'CANCELLED' ELSE arg_max(event_type, arrival) END AS status,
    arg_max(occurred_at, arrival) AS updated_at
  FROM oe GROUP BY order_id
)"""

_BATCH_EVENTS = """
be AS (
  SELECT 'b-' || (o_orderkey // 4) AS batch_id, CASE WHEN o_orderkey % 4 = 0 THEN 'recipe-' || (o_orderkey // 4 % 7) END AS recipe_id,
    CASE WHEN o_orderkey % 4 <> 3 THEN 'potion-' || (o_custkey % 3) END AS potion_id,
    CASE WHEN o_orderkey % 4 = 1 OR (o_orderkey % 4 = 2 AND o_orderkey // 4 % 5 <> 0) THEN 'cauldron-' || (o_orderkey // 4 % 50) END AS cauldron_id,
    o_orderkey AS k,
    CASE o_orderkey % 4 WHEN 0 THEN 'BATCH_CREATED' WHEN 1 THEN 'BATCH_CAULDRON_ASSIGNED' WHEN 2 THEN 'BATCH_BREWING_STARTED'
      ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'BATCH_BREWING_COMPLETED' ELSE 'BATCH_PAUSED' END END AS event_type,
    strftime(o_orderdate, '%Y-%m-%d') AS occurred_at, o_orderkey * 10 AS arrival
  FROM orders
),
ids AS (
  SELECT batch_id, id, min(place) AS place FROM (
    SELECT batch_id, 'o-' || k AS id, arrival * 10 AS place FROM be UNION ALL SELECT batch_id, 'o-' || (k - 1), arrival * 10 + 2 FROM be
  ) GROUP BY batch_id, id
),
batch_state AS (
  SELECT batch_id, arg_max(recipe_id, arrival) FILTER (recipe_id IS NOT NULL) AS recipe_id, arg_max(potion_id, arrival) FILTER (potion_id IS NOT NULL) AS potion_id,
    arg_max(cauldron_id, arrival) FILTER (cauldron_id IS NOT NULL) AS cauldron_id,
    CASE arg_max(event_type, arrival) WHEN 'BATCH_CREATED' THEN 'CREATED' WHEN 'BATCH_CAULDRON_ASSIGNED' THEN 'CAULDRON_ASSIGNED' WHEN 'BATCH_BREWING_STARTED' THEN 'BREWING'
      WHEN 'BATCH_BREWING_COMPLETED' THEN 'WAITING_FOR_BOTTLING' ELSE arg_max(event_type, arrival) END AS status,
    (SELECT string_agg(id, ',' ORDER BY place) FROM ids i WHERE i.batch_id = be.batch_id) AS order_ids,
    arg_max(occurred_at, arrival) AS updated_at
  FROM be GROUP BY batch_id
),
act AS (SELECT cauldron_id, batch_id, arrival FROM be WHERE event_type IN ('BATCH_CAULDRON_ASSIGNED', 'BATCH_BREWING_STARTED') AND cauldron_id IS NOT NULL)"""

_TELEMETRY = (
    _BATCH_EVENTS
    + """,
tel AS (
  SELECT event_id * 15 + 7 AS arrival, 'cauldron-' || (user_id % 50) AS cauldron_id, CASE WHEN event_id % 7 = 0 THEN 'b-' || (event_id % 1000) END AS own,
    80.0::DOUBLE + (event_id % 200) / 10.0::DOUBLE AS temp, 1.1::DOUBLE + (event_id % 30) / 200.0::DOUBLE AS dens,
    CASE WHEN event_id % 101 <> 0 THEN epoch_us(ts) // 1000 - CASE WHEN event_id % 9 = 0 THEN 3600000 ELSE 0 END END AS occurred
  FROM events
),
joined AS (SELECT t.*, coalesce(t.own, a.batch_id) AS batch FROM tel t ASOF LEFT JOIN act a ON a.cauldron_id = t.cauldron_id AND a.arrival < t.arrival),
found AS (SELECT j.*, b.recipe_id AS batch_recipe_id FROM joined j JOIN batch_state b ON b.batch_id = j.batch),
model AS (
  SELECT *, 420.0::DOUBLE + abs(temp - 93.0::DOUBLE) * 11.0::DOUBLE + abs(dens - 1.18::DOUBLE) * 160.0::DOUBLE AS units,
    CASE WHEN temp >= 90 THEN 'waxing_gibbous' ELSE 'waning_crescent' END AS moon, CASE WHEN dens >= 1.21::DOUBLE THEN 'volatile' ELSE 'favorable' END AS planets
  FROM found
),
eta AS (
  SELECT *, greatest(floor(units * CASE moon WHEN 'waxing_gibbous' THEN 1.08::DOUBLE ELSE 0.92::DOUBLE END * CASE planets WHEN 'favorable' THEN 0.97::DOUBLE ELSE 1.12::DOUBLE END
      * (1.0::DOUBLE + abs(92.0::DOUBLE - temp) / 250.0::DOUBLE) * (1.0::DOUBLE + abs(1.15::DOUBLE - dens) / 3.0::DOUBLE) + 0.5)::BIGINT, 1) AS eta_seconds,
    lag(temp) OVER w AS p_temp, lag(units) OVER w AS p_units, lag(occurred) OVER w AS p_occurred
  FROM model WINDOW w AS (PARTITION BY batch ORDER BY arrival)
)"""
)


def _java_hash(text: str) -> str:
    step = "((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: {step})"



def _abs_hash(text: str) -> str:
    return f"abs({_java_hash(text)})"


_FLAVOUR = f"""
created AS (SELECT *, {_abs_hash("customer_id")} AS hc, {_abs_hash("order_id")} AS ho FROM oe WHERE event_type = 'ORDER_CREATED'),
flavours AS (
  SELECT order_id, 'flavour-' || lower(to_hex(hc)) AS flavour_profile_id, CASE hc % 4 WHEN 0 THEN 'ember-gold' WHEN 1 THEN 'moonlit-teal' WHEN 2 THEN 'violet-smoke' ELSE 'moss-and-silver' END AS palette,
    round(0.92::DOUBLE + (ho % 18) / 100.0::DOUBLE, 6) AS eta_correction_factor, CASE WHEN regexp_matches(occurred_at[-2:-2], '^[0-9]$') THEN 'full_moon' ELSE 'waxing_gibbous' END AS moon_phase,
    occurred_at AS updated_at, arrival
  FROM created
)"""

QUERIES = {
    "order_state_fold": (order_state_fold, f"WITH {_ORDER_EVENTS} SELECT * FROM order_state"),
    "fold_onto_state": (fold_onto_state, f"WITH {_ORDER_EVENTS} SELECT * FROM order_state"),
    "batch_state_fold": (batch_state_fold, f"WITH {_BATCH_EVENTS} SELECT * FROM batch_state"),
    "active_batches": (active_batches, f"WITH {_BATCH_EVENTS} SELECT cauldron_id, arg_max(batch_id, arrival) AS batch_id FROM act GROUP BY cauldron_id"),
    "active_batch_asof": (active_batch_asof, f"WITH {_TELEMETRY} SELECT arrival, cauldron_id, batch FROM joined"),
    "telemetry_enriched": (telemetry_enriched, f"WITH {_TELEMETRY} SELECT arrival, cauldron_id, batch, batch_recipe_id, temp AS temperature_c FROM found"),
    "eta_normalized": (
        eta_normalized,
        f"WITH {_TELEMETRY} SELECT arrival, batch, round(units, 6) AS magical_eta_units, moon AS moon_phase, planets AS planetary_alignment, eta_seconds, "
        "'mrb-' || batch || '-' || cauldron_id AS regulatory_trace_id, round(p_temp, 6) AS previous_temperature_c, round(p_units, 6) AS previous_magical_eta_units FROM eta",
    ),
    "event_gap": (
        event_gap,
        f"WITH {_TELEMETRY}, g AS (SELECT occurred - p_occurred AS gap FROM eta) SELECT count(*) FILTER (gap >= 0) AS gap_count, round(avg(gap) FILTER (gap >= 0), 3) AS gap_avg_ms, "
        "min(gap) FILTER (gap >= 0) AS gap_min_ms, max(gap) FILTER (gap >= 0) AS gap_max_ms, count(*) FILTER (gap < 0) AS out_of_order FROM g",
    ),
    "order_tracking_lookup": (
        order_tracking_lookup,
        f"WITH {_ORDER_EVENTS}, {_BATCH_EVENTS}, {_FLAVOUR} SELECT o.order_id, o.status, o.batch_id, b.status AS batch_status, b.cauldron_id, f.palette "
        "FROM order_state o LEFT JOIN batch_state b USING (batch_id) LEFT JOIN (SELECT * FROM flavours WHERE arrival % 3 = 0) f ON f.order_id = o.order_id",
    ),
    "flavour_model": (flavour_model, f"WITH {_ORDER_EVENTS}, {_FLAVOUR} SELECT * EXCLUDE (arrival) FROM flavours"),
    "conditional_enrichment": (
        conditional_enrichment,
        f"WITH {_ORDER_EVENTS} SELECT arrival, event_type, CASE WHEN event_type = 'ORDER_CREATED' THEN 'flavour-' || lower(to_hex({_abs_hash('customer_id')})) END AS flavour_profile_id FROM oe",
    ),
    "brewing_receipts": (
        brewing_receipts,
        f"""SELECT 'b-' || (o_orderkey // 4) AS batch_id, o_orderkey % 4 + 1 AS step_number,
  'acr-b-' || (o_orderkey // 4) || '-' || (o_orderkey % 4 + 1) || '-' || lower(to_hex({_abs_hash("'mrb-é-' || o_orderkey")})) AS receipt_id,
  'acr-shard-0' || ({_abs_hash("'b-' || (o_orderkey // 4)")} % 8 + 1) AS registry_shard FROM orders""",
    ),
    "batch_completion": (
        batch_completion,
        f"WITH {_ORDER_EVENTS}, {_BATCH_EVENTS}, sizes AS (SELECT batch_id, CASE WHEN substr(batch_id, 3)::BIGINT % 3 = 0 THEN 2 ELSE count(*) END AS n_orders FROM be GROUP BY batch_id), "
        "d AS (SELECT batch_id, count(DISTINCT order_id) AS completed FROM oe WHERE event_type = 'ORDER_COMPLETED' GROUP BY batch_id) "
        "SELECT batch_id, n_orders::BIGINT AS n_orders, completed FROM sizes JOIN d USING (batch_id) WHERE completed >= n_orders",
    ),
    "lifecycle_event_union": (
        lifecycle_event_union,
        """WITH o AS (SELECT 'o-' || o_orderkey AS key, 'b-' || (o_orderkey // 4) AS b, o_orderkey // 4 * 60000 AS start, o_orderkey * 1000 AS created,
  row_number() OVER (PARTITION BY o_orderkey // 4 ORDER BY o_orderkey) - 1 AS place FROM orders),
b AS (SELECT DISTINCT b, start FROM o),
script AS (SELECT * FROM (VALUES ('BATCH_CREATED', 0), ('BATCH_REAGENTS_PREPARATION_STARTED', 1000), ('BATCH_REAGENTS_PREPARED', 2000), ('BATCH_CAULDRON_REQUESTED', 3000),
  ('BATCH_CAULDRON_ASSIGNED', 4000), ('BATCH_BREWING_STARTED', 5000), ('BATCH_BREWING_STEP_COMPLETED', 25000), ('BATCH_BREWING_STEP_COMPLETED', 55000),
  ('BATCH_BREWING_STEP_COMPLETED', 85000), ('BATCH_BREWING_COMPLETED', 120000), ('BATCH_BOTTLING_STARTED', 122000), ('BATCH_BOTTLING_COMPLETED', 132000)) v(event_type, after))
SELECT 'order' AS stream, key, '' AS batch_id, 'ORDER_CREATED' AS event_type, created AS occurred_ms FROM o
UNION ALL SELECT 'order', key, b, 'ORDER_BATCH_ASSIGNED', start + 3000 FROM o
UNION ALL SELECT 'order', key, b, 'ORDER_WAITING_FOR_BOTTLING', start + 120000 FROM o
UNION ALL SELECT 'order', key, b, 'ORDER_COMPLETED', start + 130000 + place * 25 FROM o
UNION ALL SELECT 'batch', b, b, event_type, start + after FROM b, script""",
    ),
    "fleet_telemetry": (
        fleet_telemetry,
        """SELECT event_id AS sequence, 'cauldron-0-0-' || lpad((event_id % 32 + 1)::VARCHAR, 4, '0') AS cauldron_id, 'fleet-batch-0-0-' || lpad((event_id % 32 + 1)::VARCHAR, 8, '0') AS batch_id,
  round(88.0 + sin((event_id % 300) / 4.0) * 6.0, 6) AS temperature_c, round(greatest(65.0 - event_id % 300 * 0.4, 5.0), 6)::DOUBLE AS fuel_level_pct,
  round(least(0.2 + event_id % 300 * 0.01, 0.95), 6)::DOUBLE AS soot_index,
  array_to_string(list_transform(range(0, 16), lambda k: lpad(lower(to_hex((event_id % 300 + k) % 256)), 2, '0')), '') AS blob FROM events""",
    ),
}
