"""Audit logs: lines of `|`-separated fields, plain or gzip, and their parser.

P|topic|partition|offset|kafka_ts|audit_ts|key          a publish
C|topic|partition|offset|audit_ts|key                   processed (F: failed, R: an attempt to be repeated)
D|topic|partition|offset|audit_ts|key[|reason]          dropped
S|...                                                   a marker, left out

The split is unlimited: a key with `|` in it makes the number of fields wrong, which is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a row stands in what was read: given files first, in their order, then a folder's by name.
ARRIVAL = "struct<given:int,file:string,block:bigint,row:bigint>"


def read_lines(spark: SparkSession, files: Sequence[str] = (), folder: str | None = None, glob: str = "*.log.gz") -> DataFrame:
    """value and arrival of every line.

    Files of any number are read by all tasks; a gzip file is one task's, so long logs should be many
    files or plain. The order of lines is kept as a column, not by the order of tasks.
    """
    if not files and not folder:
        raise ValueError("give files or a folder")
    parts = [_lines(spark.read.text(path), k) for k, path in enumerate(files)]
    if folder:
        parts.append(_lines(spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder), len(parts)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _lines(text: DataFrame, place: int) -> DataFrame:
    return text.select(
        "value",
        F.struct(
            F.lit(place).alias("given"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("arrival"),
    )


def is_record(value: Column | str = "value") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.rlike(r"\S") & ~value.startswith("S|")


def parse(lines: DataFrame) -> DataFrame:
    """schemas.AUDIT and arrival of the lines that are records; a malformed one fails the query."""
    rows = lines.where(is_record()).withColumn("f", F.split("value", r"\|", -1))
    kind, n = F.col("f")[0], F.size("f")
    good = ((kind == "P") & (n == 7)) | (kind.isin("C", "F", "R") & (n == 6)) | ((kind == "D") & n.isin(6, 7))
    checked = F.when(good, kind).otherwise(F.raise_error(F.concat(F.lit("not an audit record: "), F.col("value"))).cast("string"))
    published = kind == "P"
    at = lambda p, other: F.when(published, F.get("f", F.lit(p))).otherwise(F.get("f", F.lit(other)))
    return rows.select(
        checked.alias("record_type"),
        F.get("f", F.lit(1)).cast("int").alias("topic_id"),
        F.get("f", F.lit(2)).cast("int").alias("partition"),
        F.get("f", F.lit(3)).cast("bigint").alias("offset"),
        F.when(published, F.get("f", F.lit(4)).cast("bigint")).alias("kafka_ts_ms"),
        at(5, 4).cast("bigint").alias("audit_ts_ms"),
        at(6, 5).alias("message_key"),
        F.when(kind == "D", F.get("f", F.lit(6))).alias("drop_reason"),
        "arrival",
    )


def read_audit(spark: SparkSession, files: Sequence[str] = (), folder: str | None = None, glob: str = "*.log.gz") -> DataFrame:
    return parse(read_lines(spark, files, folder, glob))


def from_lines(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    """Records of lines at hand, in their order."""
    return parse(spark.createDataFrame(list(enumerate(lines)), "arrival bigint, value string"))
