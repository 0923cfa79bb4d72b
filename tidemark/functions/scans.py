"""Running values over ordered rows, in two levels.

A window over a group is one task for each group: a partition of a log with billions of records, or a
key that a third of all rows share, would be one task's work. prefix() cuts a group into chunks by an
expression that never falls as the order goes on (a range of offsets, a span of time). Each chunk is
scanned by its own task; a summary of one row a chunk is scanned in turn and handed to the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {"max": F.max, "min": F.min, "sum": F.sum}


def prefix(
    df: DataFrame,
    name: str,
    value: Column,
    group: Sequence[str],
    order: Sequence[str],
    kind: str = "max",
    chunk: Column | None = None,
) -> DataFrame:
    """df with `name`: value combined over the rows of the group that come before each row.

    kind is max, min or sum; null where no row with a value comes before. With max, a value of
    struct(order, x) makes lag(). The group's columns may not be null. chunk must not fall along the
    order within a group; without it the group is scanned by one task.
    """
    combine = _COMBINE[kind]
    rows = df.withColumn("_value", value)
    before = Window.partitionBy(*group)
    if chunk is None:
        running = before.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, combine("_value").over(running)).drop("_value")
    rows = rows.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = before.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*group, "_chunk").agg(combine("_value").alias("_sum"))
    carry = carry.withColumn("_carry", combine("_sum").over(outer)).drop("_sum")
    out = rows.withColumn("_inner", combine("_value").over(inner)).join(carry, [*group, "_chunk"])
    if kind == "sum":
        both = F.when(
            F.col("_inner").isNotNull() | F.col("_carry").isNotNull(),
            F.coalesce("_inner", F.lit(0)) + F.coalesce("_carry", F.lit(0)),
        )
    elif kind == "max":
        both = F.greatest("_inner", "_carry")
    else:
        both = F.least("_inner", "_carry")
    kept = [c for c in df.columns if c != name]
    return out.withColumn("_both", both).select(*kept, F.col("_both").alias(name))


def previous(
    df: DataFrame, name: str, value: Column, group: Sequence[str], order: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """df with `name`: the last non-null value of the group's rows before each row."""
    stamped = F.when(value.isNotNull(), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.alias("v")))
    out = prefix(df, "_stamped", stamped, group, order, "max", chunk)
    kept = [c for c in df.columns if c != name]
    return out.select(*kept, F.col("_stamped.v").alias(name))


def numbered(df: DataFrame, name: str, group: Sequence[str], order: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """df with `name`: the row's place in its group, from 0."""
    out = prefix(df, name, F.lit(1).cast("bigint"), group, order, "sum", chunk)
    return out.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
