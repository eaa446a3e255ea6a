"""Arriving files as deltas of an index (an addition: a snapshot is what is compared elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seine.operators.index import Index


def ingest(arriving: DataFrame, index: Index, checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch of (path, content, mtime, size) becomes a segment; a replayed batch changes nothing.

    A batch names only what arrived, so nothing outside of it is a deletion. Of
    a path that arrives more than once in a batch, the row of the latest time counts.
    """

    def batch(rows: DataFrame, _: int) -> None:
        columns = [c for c in rows.columns if c != "path"]
        latest = rows.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("mtime", F.xxhash64("content"))).alias("x")).select("path", "x.*")
        if index.meta() is None:
            index.build(latest)
        else:
            index.append(latest)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
