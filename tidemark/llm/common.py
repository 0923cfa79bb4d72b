"""Shared pieces: the shared folder, written intermediates and Arrow batch maps."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the session names none and is one process (tests) is a temporary folder set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage with files that outlive a lost executor, and it makes both sides of a later
    join plain scans below their exchanges, the form in which AQE may split a hot key's partition.
    """
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of an Arrow batch of texts: what a batch holds exists several times over, in the JVM and in Python.
BATCH_ROWS = 250


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch to BATCH_ROWS; a lower one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """fn over Arrow batches; a batch is bounded by BATCH_ROWS and Spark's bytes limit."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


_KEPT: dict = {}
LIBC = ctypes.CDLL(None)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, whichever operator made it.

    Workers outlive stages, so what each operator of a pipeline kept would add up in every one of them.
    """
    found = _KEPT.get(key)
    if found is None:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(LIBC, "malloc_trim"):  # glibc
            LIBC.malloc_trim(0)
        found = _KEPT[key] = make()
    return found


def rows_of(column: pa.Array) -> Iterator:
    """Values one by one, so that only one text at a time is a Python object."""
    return (x.as_py() for x in column)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
