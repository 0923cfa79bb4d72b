"""Sources, sinks and streaming: files in, the same out."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import modes
from tidemark.operators.modes import Mode
from tidemark.schemas import RECORD
from tidemark.sinks import audit as audit_sink
from tidemark.sinks.state import StateTable, write_log
from tidemark.sources import audit as audit_source
from tidemark.sources import derived, generator, records
from tidemark.streaming import consumer as streaming
from tidemark.streaming.stateful import bounded_match_stream, exactly_once, replace_pending_stream

SF = "/root/testdata/sf0.001"


def test_audit_files_keep_their_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "given.log").write_text("P|1|0|1|1|1|a\n\nS|x\n")
    import gzip

    for name in ("b.log.gz", "a.log.gz", "c.txt"):
        with gzip.open(tmp_path / "d" / name, "wt") as f:
            f.write(f"C|1|0|2|5|{name}\nC|1|0|3|6|{name}\n")
    got = audit_source.read_audit(spark, [f"file://{tmp_path}/given.log"], f"file://{tmp_path}/d").orderBy("arrival").collect()
    assert [(r.offset, r.message_key) for r in got] == [(1, "a"), (2, "a.log.gz"), (3, "a.log.gz"), (2, "b.log.gz"), (3, "b.log.gz")]
    with pytest.raises(ValueError):
        audit_source.read_lines(spark)


def test_audit_lines(spark):
    rows = [("C", 3, 4, 77, None, 1234, "cauldron-1", None), ("F", 1, 1, 12, None, 5678, "order-1", None), ("D", 1, 1, 12, None, 5678, None, " "), ("D", 1, 1, 12, None, 5, "k", "stale_age")]
    from tidemark.schemas import AUDIT

    got = [r[0] for r in spark.createDataFrame(rows, AUDIT).select(audit_sink.encode()).collect()]
    assert got == ["C|3|4|77|1234|cauldron-1", "F|1|1|12|5678|order-1", "D|1|1|12|5678|", "D|1|1|12|5|k|stale_age"]
    assert audit_sink.shutdown_marker("drain", 9) == "S|shutdown|drain|9"


def test_audit_files_round_trip(spark, tmp_path):
    made = derived.audit_records(derived.events(spark, SF))
    audit_sink.write_audit(made, f"file://{tmp_path}/log")
    back = audit_source.read_audit(spark, folder=f"file://{tmp_path}/log", glob="*.txt.gz")
    cols = [c for c in made.columns if c != "arrival"]
    assert back.select(cols).exceptAll(made.select(cols)).count() == 0 and back.count() == made.count()


def test_subscription():
    with pytest.raises(ValueError):
        records.Subscription()
    with pytest.raises(ValueError):
        records.Subscription(["a"], "b")
    with pytest.raises(ValueError):
        records.Subscription([])
    got = records.Subscription(pattern="a.*", options={"max.poll.records": "50", "auto.offset.reset": "earliest"}).kafka_options("h:1", 4)
    assert got == {"kafka.bootstrap.servers": "h:1", "subscribePattern": "a.*", "maxOffsetsPerTrigger": "50", "minPartitions": "4", "startingOffsets": "earliest"}
    options = records.ConsumerOptions({"a": "x", "enable.auto.commit": "maybe"})
    assert options.get_int("a") is None and options.get_int("none") is None and options.get_bool("enable.auto.commit") is None
    assert records.ConsumerOptions().get_bool("enable.auto.commit") is True


def log(spark, path, rows=None):
    rows = rows or [(f"t{k % 3}", k % 2, k, f"k{k % 4}" if k % 5 else None, "v" if k % 7 else None, 1000 + k * 10) for k in range(60)]
    write_log(spark.createDataFrame(rows, RECORD).coalesce(2), path)
    return rows


def test_log_and_pattern(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = log(spark, path)
    got = records.read_log(spark, path, records.Subscription(pattern="t[01]"))
    assert got.count() == len([r for r in rows if r[0] in ("t0", "t1")]) and records.read_log(spark, path, records.Subscription(["t"])).count() == 0


def test_start_offsets(spark):
    assigned = spark.createDataFrame([("a", 0, 7), ("a", 1, 9)], "topic string, partition int, position bigint")
    committed = spark.createDataFrame([("a", 0, 5, True)], "topic string, partition int, offset bigint, metadata_ok boolean")
    got = {r.partition: (r.base, r.restores_snapshot) for r in records.start_offsets(assigned, committed).collect()}
    assert got == {0: (4, True), 1: (8, False)}


def test_decode_events(spark):
    rows = spark.createDataFrame([('{"order_id":"o","more":1}',), (None,), ("junk",)], "value string")
    got = records.decode_events(rows, "order_id string").collect()
    assert [r.event and r.event.order_id for r in got] == ["o", None, None]


def test_state_table(spark, tmp_path):
    state = StateTable(spark, f"file://{tmp_path}/s", ["id"])
    assert state.current() is None and state.get(id="a") is None
    put = lambda version, *rows: state.upsert(spark.createDataFrame(rows, "id string, v int"), version)
    put(0, ("a", 1), ("b", 2)), put(1, ("a", 3)), put(1, ("a", 4))
    want = [("a", 4), ("b", 2)]
    assert sorted(map(tuple, state.current().collect())) == want and state.get(id="a").first().v == 4
    assert sorted(map(tuple, state.compact(2, f"file://{tmp_path}/t").current().collect())) == want


def test_scripted_lifecycle(spark):
    orders = [("o1", "c1", 0), ("o2", "c2", 5)]
    batch = spark.createDataFrame(
        [("b", "p", "r", "c", 1000, 120_000, orders)],
        "batch_id string, potion_id string, recipe_id string, cauldron_id string, started_ms bigint, brew_ms bigint, orders array<struct<order_id:string,customer_id:string,created_ms:bigint>>",
    )
    events = generator.scripted_order_events(batch).collect()
    assert len(events) == 8 and {r.occurred_ms for r in events if r.event_type == "ORDER_COMPLETED"} == {131_000, 131_025}
    steps = generator.scripted_batch_events(batch).orderBy("place").collect()
    assert len(steps) == 12 and steps[3].cauldron_id == "" and steps[4].cauldron_id == "c" and steps[-1].occurred_at == "1970-01-01T00:02:13.000Z"
    warm = generator.fleet_warm_up(generator.fleet(spark, 3), 5)
    assert warm.count() == 9 and warm.where("place = 1").first().event_type == "BATCH_CAULDRON_ASSIGNED"


def test_workshop_keeps_its_order():
    shop = generator.Workshop(generator.Load(cauldrons=2, min_orders=2, max_orders=3, min_steps=2, max_steps=3, burst_every=0))
    for now in range(40):
        assert shop.emit("batch_bottling_completed", now)
    by_batch = {}
    for topic, key, kind, _ in shop.out:
        if topic == "batch.events.v1":
            by_batch.setdefault(key, []).append(kind)
    done = [k for k in by_batch.values() if k[-1] == "BATCH_BOTTLING_COMPLETED"]
    assert len(done) == 40
    for kinds in done:
        assert list(dict.fromkeys(kinds)) == ["BATCH_CREATED", *(n.upper() for n, _, _ in generator.STAGES)]
    assert shop.counts()["cauldrons_active"] <= 2


def test_workshop_telemetry_takes_turns():
    shop = generator.Workshop(generator.Load(cauldrons=3))
    for now in range(3):
        shop.emit("batch_cauldron_assigned", now)
    shop.out.clear()
    for now in range(6):
        shop.emit("cauldron_telemetry", now)
    assert [key[-1] for _, key, _, _ in shop.out] == list("123123")


def test_simulated_load_meets_its_rates(spark):
    got = generator.simulated_load(spark, "100 -> (10s, steady) -> 100", 3, base_tps=100, cauldrons=4)
    by = {r.topic: r["count"] for r in got.groupBy("topic").count().collect()}
    assert abs(by["cauldron.events.v1"] - 400) <= 12 and by["order.events.v1"] >= 380 and by["batch.events.v1"] >= 180
    assert got.select("worker").distinct().count() == 3
    with pytest.raises(ValueError):
        generator.Load(order_percent=50)


def test_active_turns(spark):
    ticks = spark.range(5).withColumnRenamed("id", "sequence")
    active = spark.createDataFrame([(0, "c1"), (1, "c2")], "place bigint, cauldron_id string")
    assert [r.cauldron_id for r in generator.active_turns(ticks, active).orderBy("sequence").collect()] == ["c1", "c2", "c1", "c2", "c1"]
    assert generator.active_turns(ticks, active.where("false")).count() == 0


# --- consumers


class Flaky:
    """Fails for offsets divisible by 10, always; by 4, on the first attempt."""

    def __init__(self):
        self.seen = {}

    def __call__(self, record):
        n = self.seen[record["offset"]] = self.seen.get(record["offset"], 0) + 1
        if record["offset"] % 10 == 0:
            raise KeyError(record["offset"])
        if record["offset"] % 4 == 0 and n == 1:
            raise TimeoutError


@pytest.mark.parametrize("mode", [Mode.AT_LEAST_ONCE_NO_ORDERING, Mode.AT_LEAST_ONCE_KEY_ORDERING])
def test_consumer_retries_and_goes_on(spark, tmp_path, mode):
    path, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    rows = log(spark, path)
    made = streaming.consumer(spark, path).topics("t0", "t1").mode(mode).handle(Flaky()).retry(streaming.retry(TimeoutError, max_retries=2))
    made.start(out, f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    got = {r.offset: r for r in spark.read.parquet(out).collect()}
    want = {r[2]: r for r in rows if r[0] in ("t0", "t1")}
    assert set(got) == set(want)
    for k, r in got.items():
        handled = want[k][4] is not None
        assert r.outcome == ("failed" if handled and k % 10 == 0 else "processed")
        assert r.attempts == (2 if handled and k % 4 == 0 and k % 10 else 1)
    assert made.counts == {o: sum(r.outcome == o for r in got.values()) for o in {r.outcome for r in got.values()}}
    # started again: nothing is left
    made.start(out, f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == len(want) and not made.state()["failed"]


def test_freshness_consumer_equals_the_batch_form(spark, tmp_path):
    path, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    log(spark, path)
    made = streaming.consumer(spark, path).topics_pattern("t.*").mode(Mode.FRESHNESS_FIRST_REPLACE_PENDING_BY_KEY, capacity=3).batches(files=100)
    made.start(out, f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    batch = records.read_log(spark, path, records.Subscription(pattern="t.*"))
    want = {r.offset: r.reason for r in made.decide(batch, 0, 0).collect()}
    assert {r.offset: r.reason for r in spark.read.parquet(out).collect()} == want
    assert sorted(v or "" for v in set(want.values())) == ["", "new_key_queue_full", "replaced_by_newer_key_record"]


def test_consumer_validation(spark):
    c = lambda **o: streaming.consumer(spark, "x", o)
    for bad in (
        c(), c().topics("a").topics_pattern("b"), c().topics("a").mode(Mode.AT_LEAST_ONCE_NO_ORDERING, max_age_ms=5),
        c(**{"enable.auto.commit": "false"}).topics("a").mode(Mode.FRESHNESS_FIRST_DROP_OLDEST), c().topics("a").mode(Mode.AT_LEAST_ONCE_NO_ORDERING, capacity=0),
    ):
        with pytest.raises(ValueError):
            bad.validate()
    for bad in (lambda: streaming.retry(), lambda: streaming.retry(KeyError, max_retries=-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        streaming.require_supported("container", Mode.AT_LEAST_ONCE_KEY_ORDERING)


def test_handling_branches():
    waits, failures = [], []
    handling = streaming.Handling(
        Flaky(), streaming.RetryPolicy((streaming.retry(TimeoutError, max_retries=1, delay_seconds=0.5), streaming.retry(Exception, max_retries=1))),
        on_failure=lambda r, e: failures.append(type(e)), sleep=waits.append, context=lambda r, run: run(),
    )
    record = lambda o: {"offset": o, "value": "v", "timestamp": 0}
    assert handling.run(record(4))[:3] == ("processed", 2, None) and waits == [0.5]
    assert handling.run(record(10))[:3] == ("failed", 2, "KeyError") and failures == [KeyError]
    assert handling.run({"offset": 10, "value": None, "timestamp": None})[0] == "processed"

    def broken(record, error):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        streaming.Handling(Flaky(), on_failure=broken).run(record(10))


def test_registry(spark):
    class Fake:
        def __init__(self, name):
            self.name, self.running, self.query = name, True, None

        def stop(self, timeout):
            stopped.append(self.name)
            self.running = False
            if self.name == "b":
                raise RuntimeError("b")

    stopped = []
    registry = streaming.Registry()
    for name in "abc":
        registry.register(name, lambda n=name: Fake(n), auto_startup=name != "c")
    registry.start()
    assert [registry.is_running(n) for n in "abc"] == [True, True, False]
    registry.start("c")
    with pytest.raises(RuntimeError, match="b"):
        registry.stop()
    assert stopped == ["c", "b", "a"]
    assert registry.states(spark).count() == 3
    with pytest.raises(KeyError):
        registry.start("z")
    with pytest.raises(ValueError):
        registry.register("a", lambda: None)


def test_configuration():
    c = streaming.ConsumerConfig
    conf = streaming.Configuration(
        {"a": c(["t"]), "b": c(["t"], cluster="two", retry_schema="r", options={"x": 2})}, {"one": {"x": 1}, "two": {"x": 1, "y": 1}}, {"r": [streaming.retry(KeyError)]},
        {"default": object(), "other": object()}, default_cluster="one",
    )
    conf.validate(["a", "b"])
    assert conf.cluster_of("a") == "one" and conf.options_of("b") == {"x": 2, "y": 1} and conf.metrics_schema_of("a") == "default"
    assert conf.retry_of("b").rule_for(KeyError()) and conf.retry_of("a").rule_for(KeyError()) is None
    for handlers in (["a"], ["a", "b", "c"], ["a", "a", "b"]):
        with pytest.raises(ValueError):
            conf.validate(handlers)
    with pytest.raises(ValueError, match="no cluster"):
        streaming.Configuration({"a": c(["t"])}, {"one": {}, "two": {}}).cluster_of("a")
    assert streaming.resolve_for("a", [("a", 1), ("", 2)]) == 1 and streaming.resolve_for("z", [("a", 1), ("", 2)]) == 2
    assert streaming.resolve_for("z", [(None, 3)], use_single=True) == 3 and streaming.resolve_for("z", [(None, 3)]) is None
    with pytest.raises(ValueError, match="several"):
        streaming.resolve_for("a", [("a", 1), ("a", 2)])


# --- stateful operators


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-cp")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"file://{tmp_path}/{name}")


def test_stateful_replace_pending(spark, tmp_path, rocksdb):
    path = f"file://{tmp_path}/log"
    rows = log(spark, path, [(f"t{k % 2}", 0, k, f"k{k % 3}" if k % 5 else None, "v", 1000 + k * 10) for k in range(60)])
    log(spark, path, [("t0", 0, 999, "end", "v", 10_000_000)])
    log_stream = records.stream_log(spark, path, records.Subscription(pattern="t.*"), files_per_batch=1)
    got = {r.offset: r.outcome for r in run(replace_pending_stream(log_stream, 200, "1 hour"), tmp_path, "out").collect()}
    best = {}
    for r in rows:
        best[r[3], r[5] // 200] = r[2]
    assert got == {r[2]: "processed" if best[r[3], r[5] // 200] == r[2] else "dropped" for r in rows}


def test_bounded_match(spark, tmp_path, rocksdb):
    from tidemark.schemas import AUDIT

    lines = [("P", 1, 0, 1, 1000, 1000, "a", None), ("C", 1, 0, 1, None, 72_000, "a", None), ("P", 1, 0, 2, 1000, 70_000, "a", None), ("C", 1, 0, 2, None, 71_000, "a", None), ("P", 9, 0, 9, 1, 10_000_000, "a", None)]
    for k, part in enumerate((lines[:1], lines[1:4], lines[4:])):
        spark.createDataFrame(part, AUDIT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = run(bounded_match_stream(stream, 60_000, "1 second"), tmp_path, "out").where("topic_id = 1")
    rows = sorted((r.offset, r.published, r.processed) for r in got.collect())
    assert (2, True, True) in rows and (1, True, False) in rows and (1, False, True) in rows and len(rows) == 3


def test_exactly_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = log(spark, path)
    log(spark, path, rows)
    stream = records.stream_log(spark, path, records.Subscription(pattern=".*"), files_per_batch=1)
    assert run(exactly_once(stream), tmp_path, "out").count() == len(rows)


def test_mode_without_value_completes_unhandled(spark):
    rows = spark.createDataFrame([("t", 0, 1, "k", None, 1), ("t", 0, 2, "k", "v", 2)], "topic string, partition int, offset bigint, key string, value string, arrival bigint")
    decided = modes.unordered(rows)
    assert modes.handled(decided).count() == 1 and decided.where(F.col("outcome") == "processed").count() == 2


def test_progress(spark, tmp_path):
    from tidemark.operators.metrics import TagSchema
    from tidemark.streaming.progress import ProgressListener, poll_metrics

    path, ends = f"file://{tmp_path}/log", []
    rows = log(spark, path)
    listener = ProgressListener(on_end=ends.append)
    spark.streams.addListener(listener)
    try:
        run(exactly_once(records.stream_log(spark, path, records.Subscription(pattern=".*"))), tmp_path, "out")
        import time

        for _ in range(100):
            if ends:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {r.metric: r for r in poll_metrics(listener.frame(spark), TagSchema("shop")).collect()}
    assert got["shop.consumer.poll.records"].total == len(rows) and ends[0].startswith("S|shutdown|stopped|")


def test_settings_fall_back(spark, tmp_path):
    from tidemark.sources.documents import Settings

    settings = Settings(spark, f"file://{tmp_path}/settings", {"p90": 40, "p95": 80})
    assert settings.get() == {"p90": 40, "p95": 80}
    (tmp_path / "settings").mkdir()
    (tmp_path / "settings" / "a.json").write_text('{"version": 1, "p90": 1}\n{"version": 2, "p90": 9}\n')
    assert settings.get()["p90"] == 9 and settings.get()["p95"] == 80


def test_logs_by_labels(spark, tmp_path):
    from tidemark.sources.metrics import read_logs, streams

    (tmp_path / "l.jsonl").write_text('{"ts":"5","labels":{"b":"2","a":"1"},"line":"x"}\n{"ts":"3","labels":{"a":"1","b":"2"},"line":"y"}\n{"ts":"4","labels":{},"line":"z"}\n')
    got = {r.labels_key: (r.entries, r.first_ts, r.last_ts) for r in streams(read_logs(spark, f"file://{tmp_path}/l.jsonl")).collect()}
    assert got == {"a=1,b=2": (2, 3, 5), "": (1, 4, 4)}


def test_dashboard_metrics(spark):
    from tidemark.operators.metrics import dashboard_metrics

    rows = spark.createDataFrame([("rate(a_total[5m])",), ("a_total{x='1'} / up",)], "expression string")
    assert [r.metric for r in dashboard_metrics(rows).collect()] == ["a_total", "up"]
