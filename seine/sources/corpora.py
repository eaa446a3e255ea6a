"""Tables of texts seen as corpora of files: (path, content, mtime, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The path of a document, in SQL that Spark and DuckDB both read.
PATH = (
    "concat(lang, '/', case when doc_id % 17 = 0 then '.hid/' else '' end, source, '/', lpad(cast(doc_id as varchar(20)), 12, '0'),"
    " case doc_id % 4 when 0 then '.txt' when 1 then '.md' when 2 then '.rs' else '.py' end)"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; ``mtime`` is made from the id (seconds)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select("doc_id", F.expr(PATH).alias("path"), F.col("text").alias("content"), (1_700_000_000 + F.col("doc_id") * 37 % 1000).alias("mtime"), F.octet_length("text").cast("long").alias("size"))


def table(spark: SparkSession, sf_dir: str, name: str, key: list[str], text: str, suffix: str) -> DataFrame:
    """Any table's text column as files named by its key."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.col(text).isNotNull())
    path = F.concat(F.lit(f"{name}/"), F.concat_ws("-", *(F.col(k).cast("string") for k in key)), F.lit(suffix))
    return t.select(path.alias("path"), F.col(text).alias("content"), F.lit(0).cast("long").alias("mtime"), F.octet_length(text).cast("long").alias("size"))
