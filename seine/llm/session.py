"""Settings and shared-folder helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; long documents are bounded by the bytes below.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (a local session, as in tests) a folder below the
    warehouse folder is set; a local session runs on one machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/seine-shared"
        spark.sparkContext.setCheckpointDir(at)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders that this driver made in the shared one and has not deleted.
_made: dict[str, None] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; it is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def delete(path: str) -> None:
    """Delete a folder of ``scratch``, if it is there."""
    _made.pop(path, None)
    fs, local = filesystem(path)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(local)


def made() -> list[str]:
    """Folders of this driver that are still there, oldest first."""
    return list(_made)


@atexit.register
def _delete_all() -> None:
    for path in made():
        with contextlib.suppress(OSError):
            delete(path)


class Tables:
    """Tables of one computation, cut from their lineage: written to the shared folder and read again.

    A table stays as long as something lazy may read it: ``drop`` deletes those
    that a computation has done with, the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._paths = spark, {}

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as a table; ``by``: a column by which its rows are first gathered into few files.

        A local file system starts processes for each file (chmod), in an
        executor's name, so a table that many tasks write little of is gathered
        by a shuffle, whose partitions adaptive execution joins and splits by size.
        For the same reason, and as this driver alone reads it, it has no success marker.
        """
        path = scratch(self.spark, name)
        (df.hint("rebalance", by) if by else df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)  # the frame is held, so its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self._paths.pop(id(t))
            delete(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """One table of ``Tables`` that stays."""
    return Tables(df.sparkSession).write(df, name)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, usable on executors as well."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_order(docs: DataFrame, part_bytes: int = 256 << 20) -> DataFrame:
    """Documents ranged over tasks by id and sorted there; equal ids go by their texts' hashes.

    The number of ranges follows the bytes of text; two a core at least.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    return docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def ids_and_texts(documents: DataFrame) -> DataFrame:
    """The two columns that an operator reads, whatever others there are."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
