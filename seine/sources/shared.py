"""The folder that all executors share, for what a query has to write."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


@atexit.register
def _delete_all() -> None:
    """What queries wrote goes when the driver ends; an index of one's own is not written here."""
    for path in _made:
        with contextlib.suppress(OSError):
            fs, local = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
            fs.delete_dir(local)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session without it writes below its warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table there, cut from its lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
