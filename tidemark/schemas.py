"""Schemas of everything that is read, as DDL. None is inferred."""

RECORD = "topic string, partition int, offset bigint, key string, value string, timestamp bigint"

AUDIT = (
    "record_type string, topic_id int, partition int, offset bigint, kafka_ts_ms bigint, audit_ts_ms bigint, "
    "message_key string, drop_reason string"
)

OFFSETS = "topic string, partition int, base bigint, offset bigint"
SNAPSHOT = "head_offset bigint, head_index int, words array<bigint>"

_METADATA = "metadata struct<event_id:string,occurred_at:string,event_version:bigint,regulatory_trace_id:string>"

ORDER_EVENT = (
    f"{_METADATA}, order_id string, batch_id string, potion_id string, recipe_id string, customer_id string, event_type string, "
    "order_created struct<recipe_id:string,potion_id:string,bottle_size_ml:bigint,requested_at:string>, "
    "order_flavour_analysed struct<flavour_profile_id:string,palette:string,eta_correction_factor:double,moon_phase:string>, "
    "order_batch_assigned struct<batch_id:string,assigned_at:string>, "
    "order_waiting_for_bottling struct<batch_id:string,brewing_completed_at:string>, "
    "order_completed struct<batch_id:string,bottle_id:string,bottled_at:string>, "
    "order_cancelled struct<reason:string>, order_failed struct<reason:string>"
)

BATCH_EVENT = (
    f"{_METADATA}, batch_id string, potion_id string, recipe_id string, cauldron_id string, order_ids array<string>, event_type string, "
    "batch_created struct<order_ids:array<string>>, "
    "batch_reagents_preparation_started struct<reagent_codes:array<string>>, "
    "batch_reagents_prepared struct<reagent_codes:array<string>,prepared_at:string>, "
    "batch_cauldron_requested struct<queue_name:string,requested_at:string>, "
    "batch_cauldron_assigned struct<cauldron_id:string,assigned_at:string>, "
    "batch_brewing_started struct<started_at:string>, "
    "batch_brewing_step_completed struct<step_number:bigint,step_code:string,instruction:string,completed_at:string>, "
    "batch_brewing_completed struct<completed_at:string>, "
    "batch_bottling_started struct<started_at:string>, "
    "batch_bottling_completed struct<completed_at:string,bottles_completed:bigint>, "
    "batch_failed struct<reason:string>, batch_cancelled struct<reason:string>"
)

TELEMETRY_EVENT = (
    f"{_METADATA}, cauldron_id string, batch_id string, temperature_c double, density_sg double, bubble_rate_hz double, "
    "fuel_level_pct double, soot_index double, diagnostics_blob binary"
)

ORDER_STATE = "order_id string, batch_id string, potion_id string, recipe_id string, customer_id string, status string, updated_at string"
BATCH_STATE = (
    "batch_id string, recipe_id string, potion_id string, cauldron_id string, status string, order_ids array<string>, updated_at string"
)
FLAVOUR_STATE = (
    "order_id string, flavour_profile_id string, palette string, eta_correction_factor double, moon_phase string, "
    "model_request_id string, updated_at string"
)
ETA_CONTEXT = (
    "batch_id string, previous_temperature_c double, previous_density_sg double, previous_bubble_rate_hz double, "
    "previous_magical_eta_units double, previous_model_request_id string, updated_at string"
)
RECEIPT = (
    "batch_id string, cauldron_id string, step_number bigint, step_code string, receipt_id string, accepted_at string, "
    "registry_shard string, regulatory_trace_id string, updated_at string"
)

LOAD_PHASE = "idx int, name string, start_seconds bigint, duration_seconds bigint, start_percent double, end_percent double"
LATENCY_RULE = "id string, title string, topics array<string>, topic_ids array<int>, max_ms bigint, allowed_exceed_percent decimal(38,10)"
CRITERION = (
    "id string, title string, source string, path array<string>, measurement string, operator string, threshold double, "
    "unit string, required boolean"
)
SAMPLE = "metric string, labels map<string,string>, value double, timestamp_ms bigint"
