"""Corpora, indexes and searches for SQL: temporary views and a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seine.operators import lines as L
from seine.operators.index import Index
from seine.plans import regex as R


def register(corpus: DataFrame, index: Index | None = None, prefix: str = "") -> None:
    """Views ``files``, ``lines`` (and ``manifest``, ``postings`` of an index), and ``grep(pattern)`` over the lines.

    ``grep`` gives (path, line_no, line); it is a SQL function, so it is planned
    with the query around it. Patterns are Java's, with this engine's flags.
    """
    spark = corpus.sparkSession
    corpus.createOrReplaceTempView(f"{prefix}files")
    L.lines(corpus).createOrReplaceTempView(f"{prefix}lines")
    if index is not None:
        index.manifest().createOrReplaceTempView(f"{prefix}manifest")
        index.postings().createOrReplaceTempView(f"{prefix}postings")
    spark.sql(
        f"create or replace temporary function {prefix}grep(pattern string) returns table(path string, line_no bigint, line string)"
        f" return select path, line_no, line from {prefix}lines where line rlike concat('{R.java('')}', pattern)"
    )
