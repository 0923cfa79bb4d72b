"""Metric samples as OpenMetrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import finite


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def encode() -> Column:
    """The line of a row of schemas.SAMPLE: labels by name, up to 17 significant digits, seconds with 3."""
    entries = F.filter(F.array_sort(F.map_entries("labels")), lambda e: e["key"] != "__name__")
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    text = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))).otherwise("")
    whole = (F.col("value") == F.floor("value")) & (F.abs("value") < 1e15)
    value = F.when(whole, F.col("value").cast("decimal(20,0)").cast("string")).otherwise(F.col("value").cast("string"))
    return F.concat("metric", F.coalesce(text, F.lit("")), F.lit(" "), value, F.lit(" "), F.format_string("%.3f", F.col("timestamp_ms") / 1000))


def lines(samples: DataFrame) -> DataFrame:
    """value: a line for each finite sample, under its metric's type line, in order. EOF is the reader's end."""
    rows = samples.where(finite("value") & F.col("timestamp_ms").isNotNull())
    heads = rows.select("metric").distinct().select("metric", F.lit(0).alias("k"), F.lit("").alias("at"), F.concat(F.lit("# TYPE "), "metric", F.lit(" unknown")).alias("value"))
    labels = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    body = rows.select("metric", F.lit(1).alias("k"), F.concat(labels, F.lpad(F.col("timestamp_ms").cast("string"), 20, "0")).alias("at"), encode().alias("value"))
    return heads.unionByName(body).orderBy("metric", "k", "at").select("value")


def write_samples(samples: DataFrame, path: str) -> None:
    lines(samples).write.text(path)
