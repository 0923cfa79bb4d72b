"""Offset algebra: the contiguous frontier of out-of-order completions, and what lies beyond it.

Completions are rows of (topic, partition, offset), in any order and repeated at will. A partition's
committed base is its last committed offset. Completions beyond it are folded into bitmaps of 32,768
offsets each, combined before the shuffle, so a partition with billions of completions is many small
groups; what is left to scan in order is one row a bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTITION = ["topic", "partition"]
BITS = 32_768


def _with_base(completions: DataFrame, bases: DataFrame) -> DataFrame:
    """Completions beyond their partition's base: `ahead` counts from 1. bases: topic, partition, base."""
    rows = completions.select(*PARTITION, "offset").join(bases.select(*PARTITION, "base"), PARTITION)
    return rows.where(F.col("offset") > F.col("base")).withColumn("ahead", F.col("offset") - F.col("base"))


def bitmaps(completions: DataFrame, bases: DataFrame) -> DataFrame:
    """topic, partition, bucket (from 0), bits (binary, least bit first), last (the highest `ahead`) and n (bits set)."""
    place = F.col("ahead") - 1
    rows = _with_base(completions, bases).select(*PARTITION, "ahead", F.expr(f"(ahead - 1) div {BITS}").alias("bucket"), (place % BITS).alias("bit"))
    made = rows.groupBy(*PARTITION, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.max("ahead").alias("last"))
    return made.withColumn("n", F.bitmap_count("bits"))


def leading_ones(bits: Column) -> Column:
    """How many bits of a bitmap are set before the first that isn't."""
    digits = F.hex(bits)
    full = F.length(F.regexp_extract(digits, "^(?:FF)*", 0)) / 2
    byte = F.conv(F.substring(digits, (2 * full + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    ones = sum((F.when(byte.bitwiseAND(F.lit((1 << k) - 1)) == (1 << k) - 1, 1).otherwise(0) for k in range(1, 9)), F.lit(0))
    return (full * 8 + F.coalesce(ones, F.lit(0))).cast("bigint")


def frontier(completions: DataFrame, bases: DataFrame) -> DataFrame:
    """topic, partition, base, frontier, processed, highest: one row for each partition of bases.

    frontier: the last offset up to which all are completed (base if the next isn't). processed: the
    distinct completions beyond base. highest: the largest of them, base without any. Offsets that never
    complete (gaps of a compacted log) hold the frontier back.
    """
    made = bitmaps(completions, bases)
    order = Window.partitionBy(*PARTITION).orderBy("bucket")
    made = made.withColumn("in_line", F.col("bucket") == F.row_number().over(order) - 1)
    made = made.withColumn("whole", F.col("in_line") & (F.col("n") == BITS))
    made = made.withColumn("open", F.min(F.col("whole").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    reach = F.when(F.col("in_line") & (F.coalesce("open", F.lit(1)) == 1), F.col("bucket") * BITS + leading_ones(F.col("bits")))
    found = made.groupBy(*PARTITION).agg(
        F.max(reach).alias("reach"), F.sum("n").alias("processed"), F.max("last").alias("top")
    )
    return bases.join(found, PARTITION, "left").select(
        *PARTITION,
        "base",
        (F.col("base") + F.coalesce("reach", F.lit(0))).cast("bigint").alias("frontier"),
        F.coalesce("processed", F.lit(0)).cast("bigint").alias("processed"),
        (F.col("base") + F.coalesce("top", F.lit(0))).cast("bigint").alias("highest"),
    )


def pending(frontiers: DataFrame, most: int = 2**31 - 1) -> DataFrame:
    """pending_offsets: offsets that could be committed now over all partitions, `most` at most."""
    total = F.coalesce(F.sum(F.col("frontier") - F.col("base")), F.lit(0))
    return frontiers.agg(F.least(total, F.lit(most)).cast("bigint").alias("pending_offsets"))


def commit_data(frontiers: DataFrame) -> DataFrame:
    """Partitions with progress: commit_offset (frontier + 1, the next to read), advanced, remainder.

    remainder: completions beyond the frontier, which the commit's metadata has to carry.
    """
    return frontiers.where("frontier > base").select(
        *PARTITION,
        (F.col("frontier") + 1).alias("commit_offset"),
        (F.col("frontier") - F.col("base")).alias("advanced"),
        (F.col("processed") - (F.col("frontier") - F.col("base"))).alias("remainder"),
    )


def is_processed(records: DataFrame, frontiers: DataFrame, completions: DataFrame) -> DataFrame:
    """records with `already_processed`: at or below the frontier, or completed beyond it."""
    beyond = completions.select(*PARTITION, "offset").distinct().withColumn("_done", F.lit(True))
    known = frontiers.select(*PARTITION, F.col("frontier").alias("_frontier"))
    out = records.join(known, PARTITION, "left").join(beyond, [*PARTITION, "offset"], "left")
    done = F.coalesce(F.col("offset") <= F.col("_frontier"), F.lit(False)) | F.coalesce("_done", F.lit(False))
    return out.select(*records.columns, done.alias("already_processed"))


def restart_skip(records: DataFrame, frontiers: DataFrame, completions: DataFrame) -> DataFrame:
    """Records that a restarted consumer has still to process: an anti-join, no state."""
    beyond = completions.select(*PARTITION, "offset")
    left = records.join(frontiers.select(*PARTITION, "frontier"), PARTITION, "left")
    left = left.where(F.col("frontier").isNull() | (F.col("offset") > F.col("frontier"))).drop("frontier")
    return left.join(beyond, [*PARTITION, "offset"], "left_anti").select(*records.columns)


def capacity_bits(span: Column, least: int = 128) -> Column:
    """Bits of a ring that holds `span` offsets: a power of two of 64-bit words, `least` at least."""
    words = F.ceil(F.greatest(span, F.lit(1)) / 64)
    power = F.pow(F.lit(2.0), F.ceil(F.log2(words.cast("double")) - 1e-9))
    return F.greatest((power * 64).cast("bigint"), F.lit(least).cast("bigint"))


def compacted_bits(bits: Column, span: Column, least: int = 128, ratio: int = 4) -> Column:
    """Bits after compaction, which happens only where it saves `ratio`."""
    target = capacity_bits(span, least)
    return F.when(target * ratio <= bits, target).otherwise(bits)


def tracker_capacity(frontiers: DataFrame) -> DataFrame:
    """topic, partition, live_span, bit_capacity: the ring that the partition's live offsets need.

    The head word is the one that holds the first offset after the frontier, words counted from base.
    """
    head = F.col("base") + F.expr("((frontier - base) div 64) * 64") + 1
    span = F.greatest(F.col("highest") - head + 1, F.lit(0))
    rows = frontiers.withColumn("live_span", span.cast("bigint"))
    return rows.select(*PARTITION, "live_span", capacity_bits(F.col("live_span")).alias("bit_capacity"))


def runs(completions: DataFrame, bases: DataFrame) -> DataFrame:
    """topic, partition, start, length: runs of completed offsets beyond base, the run-length form.

    Islands are found inside buckets of offsets, then those that touch across a bucket's border are
    joined; only runs, not offsets, are scanned along a partition.
    """
    rows = _with_base(completions, bases).select(*PARTITION, "offset", F.expr(f"(ahead - 1) div {BITS}").alias("bucket")).distinct()
    inner = Window.partitionBy(*PARTITION, "bucket").orderBy("offset")
    rows = rows.withColumn("island", F.col("offset") - F.row_number().over(inner))
    parts = rows.groupBy(*PARTITION, "bucket", "island").agg(F.min("offset").alias("start"), F.max("offset").alias("end"))
    order = Window.partitionBy(*PARTITION).orderBy("start")
    fresh = F.coalesce(F.col("start") != F.lag("end").over(order) + 1, F.lit(True))
    parts = parts.withColumn("fresh", fresh.cast("int"))
    parts = parts.withColumn("run", F.sum("fresh").over(order))
    joined = parts.groupBy(*PARTITION, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(*PARTITION, "start", (F.col("end") - F.col("start") + 1).alias("length"))


def remainder_runs(completions: DataFrame, bases: DataFrame) -> DataFrame:
    """runs() beyond the frontier, which ends the run that starts at base + 1."""
    found = runs(completions, bases).join(bases.select(*PARTITION, "base"), PARTITION)
    return found.where(F.col("start") != F.col("base") + 1).drop("base")


def snapshots(completions: DataFrame, bases: DataFrame) -> DataFrame:
    """topic, partition, head_offset, head_index, words: what a commit's metadata carries (schemas.SNAPSHOT).

    One array a partition: bounded by what is out of order, which the metadata's size limit bounds.
    """
    front = frontier(completions, bases)
    head = F.col("base") + F.expr("((frontier - base) div 64) * 64") + 1
    rows = _with_base(completions, bases).drop("base").join(front, PARTITION).withColumn("head", head).where(F.col("offset") >= F.col("head"))
    word = F.expr("(offset - head) div 64").cast("int")
    bit = F.expr("shiftleft(1L, cast((offset - head) % 64 as int))")
    made = rows.groupBy(*PARTITION, "head", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    entries = made.groupBy(*PARTITION).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("at"))
    out = front.withColumn("head", head).join(entries, PARTITION, "left")
    words = (capacity_bits(F.greatest(F.col("highest") - F.col("head") + 1, F.lit(1))) / 64).cast("int")
    filled = F.transform(F.sequence(F.lit(0), words - 1), lambda k: F.coalesce(F.col("at")[k], F.lit(0).cast("bigint")))
    return out.select(*PARTITION, F.col("head").alias("head_offset"), F.lit(0).alias("head_index"), filled.alias("words"))
