"""Helpers that every operator of this subpackage uses: the shared working folder, table saves, and small batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a local master may run without that setting (as tests do); then a
    folder of this machine serves, since driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"docsift-{os.getpid()}")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/docsift/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor costs no rerun.

    discard() deletes it; what is still read when a query returns goes when the driver ends.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    until_the_end(spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._saved_at = path
    return kept


def _located(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def until_the_end(spark: SparkSession, path: str) -> None:
    """A folder of working data, which goes at the latest when the driver's JVM ends."""
    system, p = _located(spark, path)
    system.deleteOnExit(p)


def discard(spark: SparkSession, df: DataFrame | str) -> None:
    """Delete a table that save() wrote, once nothing reads it any more."""
    path = df if isinstance(df, str) else getattr(df, "_saved_at", None)
    if path:
        system, p = _located(spark, path)
        system.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with a number after it the first that no column has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def no_null_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


#: Rows that a worker turns into Python objects at once.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in small parts, so a worker's memory doesn't follow the batch size; freed memory goes back when a task ends."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
