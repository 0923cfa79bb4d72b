"""Experiments, metrics, documents, lag reports and reports."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import SUMMARY, distribution
from tidemark.operators import experiments, metrics
from tidemark.schemas import LATENCY_RULE, SAMPLE
from tidemark.sinks import metrics as metric_sink
from tidemark.sinks import report
from tidemark.sources import documents
from tidemark.sources import metrics as series

PROFILE = "0 -> (1m, warmup) -> 100 -> (30s, steady) -> 100"


def test_load_profile(spark):
    got = experiments.load_profile_phases(spark.createDataFrame([(PROFILE,)], "profile string")).orderBy("idx").collect()
    assert [(r.name, r.start_seconds, r.duration_seconds) for r in got] == [("warmup", 0, 60), ("steady", 60, 30)]
    same = experiments.parse_load_profile(PROFILE)
    assert [(p["name"], p["start_seconds"], p["duration_seconds"]) for p in same] == [("warmup", 0, 60), ("steady", 60, 30)]
    assert experiments.parse_load_profile("5 -> (2H) -> 7")[0]["name"] == "phase-0"


@pytest.mark.parametrize("text", ["", "0", "0 -> 100", "0 -> (1m, a) -> x", "0 -> (0s, a) -> 1", "0 -> [1m] -> 1", "a -> (1m, b) -> 1"])
def test_bad_profiles(spark, text):
    with pytest.raises(ValueError):
        experiments.parse_load_profile(text)
    with pytest.raises(Exception, match="unsupported load profile"):
        experiments.load_profile_phases(spark.createDataFrame([(text,)], "profile string")).collect()


def test_criteria_and_status(spark):
    profile = {"criteria": [{"id": "a", "path": ["x"], "operator": "eq", "threshold": 1}, {"id": "b", "path": ["y"], "threshold": 1, "required": False}, {"id": "c", "path": ["z"], "threshold": 1}]}
    values = spark.createDataFrame([("x", 1.0)], "path string, value double")
    got = {r.id: r.status for r in experiments.evaluate_criteria(documents.criteria(spark, profile), values).collect()}
    assert got == {"a": "PASS", "b": "NOT_EVALUATED", "c": "INCOMPLETE"}
    mixed = spark.createDataFrame([("t", "PASS"), ("t", "NOT_EVALUATED"), ("u", "NOT_EVALUATED")], "run string, status string")
    assert dict(experiments.component_status(mixed, ["run"]).collect()) == {"t": "PASS", "u": "NOT_EVALUATED"}
    assert dict(experiments.overall_status(mixed, ["run"]).collect()) == {"t": "NOT_EVALUATED", "u": "NOT_EVALUATED"}


def test_profiles_inherit():
    rule = {"id": "r", "topics": ["order.events.v1"], "max_ms": 5, "allowed_exceed_percent": 1}
    docs = {
        "base": {"name": "base", "criteria": [{"id": "a", "path": ["x"], "threshold": 0}], "latency": {"rules": [rule]}},
        "child": {"extends": "base", "name": "child", "criteria": [{"id": "b", "path": ["y"], "threshold": 0}]},
        "loop": {"extends": "pool", "criteria": []}, "pool": {"extends": "loop", "criteria": []},
    }
    got = documents.sla_profile(docs, "child")
    assert got["name"] == "child" and [c["id"] for c in got["criteria"]] == ["a", "b"] and got["latency"]["rules"] == [rule]
    with pytest.raises(ValueError, match="extend each other"):
        documents.sla_profile(docs, "loop")
    with pytest.raises(ValueError, match="unknown document"):
        documents.inherited(docs, "nothing")


@pytest.mark.parametrize(
    "change",
    [{"id": ""}, {"topics": []}, {"topics": ["nowhere"]}, {"max_ms": -1}, {"allowed_exceed_percent": 101}],
)
def test_bad_rules(change):
    rule = {"id": "r", "topics": ["order.events.v1"], "max_ms": 5, "allowed_exceed_percent": 1}
    with pytest.raises(ValueError):
        documents.check_rules([rule | change])
    with pytest.raises(ValueError):
        documents.check_rules([rule, rule | {"id": "again"}])


def test_rules_match(spark):
    row = ("r", "R", ["a"], [1], 5, Decimal(1))
    a = spark.createDataFrame([row], LATENCY_RULE)
    assert experiments.rules_match(a, a).first().matches
    assert not experiments.rules_match(a, spark.createDataFrame([(*row[:4], 6, row[5])], LATENCY_RULE)).first().matches


def test_metric_tags():
    with pytest.raises(ValueError, match="reserved"):
        metrics.TagDefinition("topic")
    with pytest.raises(ValueError, match="blank"):
        metrics.TagDefinition(" ")
    with pytest.raises(ValueError, match="more than once"):
        metrics.TagSchema("x", [metrics.TagDefinition("a"), metrics.TagDefinition("a")])


def test_undeclared_tags(spark):
    schema = metrics.TagSchema("x", [metrics.TagDefinition("a")])
    with pytest.raises(ValueError, match="undeclared"):
        schema.columns({"b": F.lit(1)})
    assert spark.range(1).select(*schema.columns({"a": F.lit(None)})).first().a == "NONE"


def test_quantile_of_nothing_and_of_the_open_bucket(spark):
    values = spark.createDataFrame([("a", 99.0), ("a", 120.0), ("b", None)], "g string, v double")
    buckets = metrics.bucket_counts(values, "v", [10.0, 100.0], ["g"])
    assert {r.g: r["count"] for r in buckets.where("le = 100").collect()} == {"a": 1}
    got = {q: metrics.histogram_quantile(buckets, q, ["g"]).first().value for q in (0.25, 0.99)}
    assert got[0.25] == pytest.approx(55.0) and got[0.99] == 100.0


def test_distribution_of_histogram_is_that_of_rows(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 5, 5, 9)], "v double")
    bins = spark.createDataFrame([(1.0, 2), (2.0, 1), (5.0, 3), (9.0, 1), (7.0, 0)], "v double, n int")
    a, b = distribution(rows, "v").first(), distribution(bins, "v", weight="n").first()
    assert a == b and a.asDict().keys() == set(SUMMARY) and a["p50"] == 5.0
    assert distribution(rows.where("false"), "v").count() == 0
    zero = distribution(spark.createDataFrame([(0.0,)], "v double"), "v").first()
    assert zero.gini is None and zero.coefficient_of_variation is None and zero.max_to_min is None


def test_drain_wait():
    now, lags = [0.0], iter([5, 0, None, 0, 0, 0, 0])
    series.wait_for_drain(lambda: next(lags), 2, 60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert now[0] == 5.0
    with pytest.raises(TimeoutError):
        series.wait_for_drain(lambda: 1, 2, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert series.first_lag(("a", lambda: None), ("b", lambda: 3.0)) == (3.0, "b") and series.first_lag() == (None, "missing")


def test_samples_round_trip(spark, tmp_path):
    rows = [("m", {"b": 'x"\\\n', "a": "1"}, 1.5, 1500), ("m", {}, 2.0, 2000), ("k", None, 3.0, 1), ("m", {}, float("nan"), 3)]
    frame = spark.createDataFrame(rows, SAMPLE)
    text = [r.value for r in metric_sink.lines(frame).collect()]
    assert text == ["# TYPE k unknown", "k 3 0.001", "# TYPE m unknown", "m 2 2.000", 'm{a="1",b="x\\"\\\\\\n"} 1.5 1.500']
    metric_sink.write_samples(frame.where("metric = 'm' and not isnan(value)"), f"file://{tmp_path}/m")
    back = {(r.value, r.timestamp_ms, tuple(sorted(r.labels.items()))) for r in series.read_samples(spark, f"file://{tmp_path}/m").collect()}
    assert back == {(1.5, 1500, (("a", "1"), ("b", 'x"\\\n'))), (2.0, 2000, ())}


def test_yaml_and_report(tmp_path):
    assert report.to_yaml({"a": {"b": [1, {"c": None, "d": [True]}], "e": {}}, "f": 'x"y'}).splitlines() == [
        "a:", "  b:", "    - 1", "    - c: null", "      d:", "        - true", "  e: {}", 'f: "x\\"y"',
    ]
    rule = {"title": "R", "topics": ["a"], "max_ms": 1500, "allowed_exceed_percent": 1, "processed": 5, "measured": 5, "exceeded": 1, "max_observed_ms": 70_000, "status": "FAIL"}
    target = {"name": "t|1", "delivery": "PASS", "latency": "FAIL", "overall": "FAIL", "counts": {"processed": 5}, "criteria": [], "rules": [rule], "warnings": ["w"]}
    doc = {"name": "n", "status": "FAIL", "phases": experiments.parse_load_profile(PROFILE), "targets": [target], "criteria": [], "rules": [rule]}
    made = report.write_report(doc, tmp_path / "r", 100, {"none.json": "/nowhere"})
    text = (made / "report.md").read_text()
    assert "t\\|1" in text and "1 (20.00%)" in text and "1m 10.0s" in text and (made / "load-profile.svg").read_text().startswith("<svg")
    assert report.nice_step(23) == 5 and report.tick_seconds(600) == 120 and report.clock(3700) == "01:01" and report.elapsed(61) == "1m 1s"


def test_latest_and_health(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t int, v string")
    assert sorted(map(tuple, experiments.latest(rows, ["k"], ["t"]).collect())) == [("a", 3, "y"), ("b", 2, "z")]
    none = spark.createDataFrame([], "name string, failed boolean, auto_startup boolean, running boolean")
    assert experiments.health(none).first().status == "UP"
