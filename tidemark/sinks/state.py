"""Latest state by key, kept as versions of a Parquet table; a record log; a point read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateTable:
    """Rows by key, the last write wins, nothing expires.

    An upsert appends a version (`_version`, the batch's number); the current state is the row of the
    largest version of each key, by one aggregation. Versions are folded into one by compact(). Writing
    the same version twice, as after a failure, leaves the same state.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def upsert(self, rows: DataFrame, version: int) -> None:
        self._write(rows, version)

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/_version={version}")

    def current(self) -> DataFrame | None:
        """The state; None before the first write."""
        try:
            found = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/_version=*")
        except AnalysisException:
            return None
        rest = [c for c in found.columns if c not in (*self.keys, "_version")]
        top = F.max(F.struct("_version", *rest)).alias("_top")
        return found.groupBy(*self.keys).agg(top).select(*self.keys, *(F.col(f"_top.{c}").alias(c) for c in rest))

    def get(self, **key) -> DataFrame | None:
        """A point read: the filter on the key reaches the files."""
        now = self.current()
        if now is None:
            return None
        for c, v in key.items():
            now = now.where(F.col(c) == v)
        return now

    def compact(self, version: int, target: str) -> StateTable:
        """The current state as version `version` of a table in a new folder."""
        now = self.current()
        made = StateTable(self.spark, target, self.keys)
        if now is not None:
            made._write(now, version)
        return made


def write_log(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records (schemas.RECORD) as a log that sources.records reads, a folder a topic."""
    records.withColumn("_topic", F.col("topic")).write.mode(mode).partitionBy("_topic").parquet(path)


def dry_run(records: DataFrame) -> None:
    """Everything is computed and nothing kept."""
    records.write.format("noop").mode("overwrite").save()
