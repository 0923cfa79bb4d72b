"""Metric samples, consumer lag and log lines from files and tools."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import SAMPLE

_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """schemas.SAMPLE of OpenMetrics text: comments are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(r"\S"))
    shape = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{.*\})? (\S+) (\S+)$"
    part = lambda k: F.regexp_extract("value", shape, k)
    names = F.regexp_extract_all(part(2), F.lit(_LABEL), F.lit(1))
    values = F.transform(
        F.regexp_extract_all(part(2), F.lit(_LABEL), F.lit(2)),
        lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")),
    )
    return lines.select(
        part(1).alias("metric"),
        F.map_from_arrays(names, values).alias("labels"),
        part(3).cast("double").alias("value"),
        F.round(part(4).cast("double") * 1000).cast("bigint").alias("timestamp_ms"),
    )


def samples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SAMPLE)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """labels_key, labels, ts, line of JSON lines ({"ts", "labels", "line"}); labels_key is the sorted labels."""
    rows = spark.read.schema("ts string, labels map<string,string>, line string").json(path)
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(F.concat_ws(",", entries).alias("labels_key"), "labels", F.col("ts").cast("bigint").alias("ts"), "line")


def streams(logs: DataFrame) -> DataFrame:
    """labels_key, entries, first_ts, last_ts of each stream of log lines."""
    return logs.groupBy("labels_key").agg(F.count("*").alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Lines of a group's description that hold numbers, but no lag. Fixed values.
_OTHER = ("GROUP", "COORDINATOR", "STATE", "BALANCER", "MEMBERS")


def _cells(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def lag_of_description(reports: DataFrame, keep: list[str], column: str = "output") -> DataFrame:
    """keep, lag: of a broker tool's description with a TOPIC header; its TOTAL-LAG if it gives one.

    Else the sum of the LAG column, negative ones as 0.
    """
    rows = reports.select(*keep, F.posexplode(F.split(column, r"\r?\n")).alias("at", "line")).withColumn("c", _cells(F.col("line")))
    word = F.upper(F.get("c", F.lit(0)))
    rows = rows.where(F.size("c") > 0).withColumn("word", word)
    total = F.max(F.when((F.col("word") == "TOTAL-LAG") & (F.size("c") >= 2), F.greatest(F.get("c", F.lit(1)).try_cast("bigint"), F.lit(0))))
    return _lag(rows, keep, "TOPIC", _OTHER, total)


def lag_of_groups(reports: DataFrame, keep: list[str], column: str = "output") -> DataFrame:
    """keep, lag: of a broker tool's table with a GROUP header; null without a row."""
    rows = reports.select(*keep, F.posexplode(F.split(column, r"\r?\n")).alias("at", "line")).withColumn("c", _cells(F.col("line")))
    rows = rows.where(F.size("c") > 0).withColumn("word", F.upper(F.get("c", F.lit(0))))
    return _lag(rows, keep, "GROUP", (), None)


def _lag(rows: DataFrame, keep: list[str], header: str, other: tuple, total: Column | None) -> DataFrame:
    """The lag column is where the last header above a line has it; reports are single texts, so is the order."""
    from pyspark.sql import Window

    place = F.when(F.array_position("c", "LAG") > 0, F.array_position("c", "LAG")).otherwise(0)
    upto = Window.partitionBy(*keep).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("col", F.last(F.when(F.col("word") == header, place), ignorenulls=True).over(upto))
    cell = F.get("c", (F.col("col") - 1).cast("int"))
    counts = (F.col("word") != header) & ~F.col("word").isin(*other, "TOTAL-LAG") & (F.col("col") > 0) & cell.rlike(r"^-?\d+$")
    lag = F.sum(F.when(counts, F.greatest(cell.try_cast("bigint"), F.lit(0))))
    if total is None:
        return rows.groupBy(*keep).agg(lag.alias("lag"))
    return rows.groupBy(*keep).agg(F.coalesce(total, lag, F.lit(0)).alias("lag"))


def first_lag(*sources: tuple[str, Callable[[], float | None]]) -> tuple[float | None, str]:
    """The first source that knows the lag, and its name; (None, "missing") if none does."""
    for name, source in sources:
        lag = source()
        if lag is not None:
            return lag, name
    return None, "missing"


def wait_for_drain(
    lag: Callable[[], float | None], stable_seconds: float, timeout_seconds: float, poll_seconds: float = 1.0,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> None:
    """Returns once the lag has been 0 or less for stable_seconds; a missing lag starts the time again."""
    deadline, since = clock() + timeout_seconds, None
    while clock() < deadline:
        now = lag()
        if now is None or now > 0:
            since = None
        else:
            since = clock() if since is None else since
            if clock() - since >= stable_seconds:
                return
        sleep(poll_seconds)
    raise TimeoutError(f"the lag did not drain within {timeout_seconds} s")
