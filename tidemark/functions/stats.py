"""Exact distributions: percentiles, coefficient of variation, Gini coefficient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import round6

SUMMARY = ("count", "avg", "min", "p50", "p95", "p99", "max", "coefficient_of_variation", "gini", "max_to_min")


def histogram(df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """group, value and n: how often each value comes. Combined before the shuffle."""
    n = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(n.cast("bigint").alias("n"))


def distribution(df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row a group with values: SUMMARY, exact, rounded to 6 digits; nulls are left out.

    Values are folded into a histogram first, so what is sorted is a group's distinct values. The
    percentile is linear on (n - 1) * q, the deviation that of the population. The coefficient of
    variation is null where the mean is 0, Gini where the sum is, max_to_min where the minimum is 0.
    """
    bins = histogram(df, value, group, weight).where("n > 0").withColumn("v", F.col(value).cast("double"))
    whole, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("mean", F.sum(F.col("v") * F.col("n")).over(whole) / F.sum("n").over(whole))
    bins = bins.withColumn("seen", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    rank = F.col("n") * (2 * F.col("seen") + F.col("n") + 1) / 2
    total, count = F.sum(F.col("v") * F.col("n")), F.sum("n")
    quantile = F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    spread = F.sqrt(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))) / count)
    out = bins.groupBy(*group).agg(
        count.cast("bigint").alias("count"),
        total.alias("_total"),
        (total / count).alias("_avg"),
        F.min("v").alias("_min"),
        F.max("v").alias("_max"),
        quantile.alias("_q"),
        spread.alias("_sd"),
        F.sum(F.col("v") * rank).alias("_ranked"),
    )
    gini = 2 * F.col("_ranked") / (F.col("count") * F.col("_total")) - (F.col("count") + 1) / F.col("count")
    return out.where("count > 0").select(
        *group,
        "count",
        round6(F.col("_avg")).alias("avg"),
        round6(F.col("_min")).alias("min"),
        *(round6(F.col("_q")[k]).alias(name) for k, name in enumerate(("p50", "p95", "p99"))),
        round6(F.col("_max")).alias("max"),
        round6(F.when(F.col("_avg") != 0, F.col("_sd") / F.col("_avg"))).alias("coefficient_of_variation"),
        round6(F.when(F.col("_total") != 0, gini)).alias("gini"),
        round6(F.when(F.col("_min") != 0, F.col("_max") / F.col("_min"))).alias("max_to_min"),
    )


def long_form(df: DataFrame, values: dict[str, Column], keep: Sequence[str] = (), name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each named value of a row, as doubles."""
    pairs = F.array(*(F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in values.items()))
    return df.select(*keep, F.explode(pairs).alias("_pair")).select(*keep, f"_pair.{name}", f"_pair.{value}")


def age_stats(c: Column, prefix: str = "") -> list[Column]:
    """count, avg (3 digits), min and max of a column of milliseconds, nulls left out."""
    return [
        F.count(c).alias(f"{prefix}count"),
        F.round(F.avg(c), 3).alias(f"{prefix}avg_ms"),
        F.min(c).cast("bigint").alias(f"{prefix}min_ms"),
        F.max(c).cast("bigint").alias(f"{prefix}max_ms"),
    ]
