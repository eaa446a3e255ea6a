"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import decontaminate, neardup, packing, pii, toxicity
from seine.llm.session import delete, documents, made, written


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold for toxic.

    A text without words (null or empty) has the class prior and stays; without
    a toxic label to learn from, all stay; repeated rows are judged alike, each
    staying or going; an empty table gives none; other columns stay as they are.
    """
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): that of the smallest id.

    Null and empty texts, and rows without an id, are near nothing and stay;
    rows of one id are one document and stay or go together, which is why a
    repeated row stays repeated; ties can't be, as ids decide; other columns
    stay as they are.
    """
    return neardup.deduplicated(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages.

    A null or empty text stays so; a text that is all passage stays, empty of
    it; passages of items without an id go too; repeated rows are each cut;
    ``n_chars``, where there is such a column, follows the text.
    """
    return _measured(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kinds.

    A null or empty text stays so; repeated rows are each redacted; ``n_chars``,
    where there is such a column, follows the text.
    """
    return _measured(pii.redacted(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each;
    other columns are left behind; no documents give no pieces.
    """
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_tokens),
]

#: No stage's method is SQL's; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of each stage's tables only its result stays, until the next one is written."""
    docs = documents(spark, sf_dir)
    before = set(made())
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in [p for p in made() if p not in before][:-1]:
            delete(path)
    return docs

