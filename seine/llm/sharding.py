"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every document hashes to a place on a ring of ``BUCKETS`` equal arcs; each
shard owns ``VNODES`` points of it. A document belongs to the first point at or
after its place. A shard takes at most its capacity: documents that find it
full go on clockwise to the next shard with room. Capacities are ``(1 + slack)``
times the mean number of rows; with no slack (the default) they are the mean,
rounded up for the first shards of the remainder and down for the others, so
that counts differ by at most one (law ``rows``).

Only the histogram of the arcs, whose length is a constant, comes to the
driver, where the arcs' counts flow around the ring; an arc that fills a shard
is divided at a row number. Rows are placed by DataFrame functions alone: one
shuffle of ids, sizes and places (never of texts), whose keys are the arcs, so
a hot source or text is spread by its ids.

Defined cases: a null text has no bytes (size 8) and is in its shard like any
other; a null id hashes to one fixed place; repeated rows are placed
separately, and may part where an arc is divided; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arcs of the ring: the length of the histogram, whatever the input.
BUCKETS = 1 << 15
VNODES = 128
SHARDS = 24


def _point(key: str) -> int:
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")


def ring(shards: int, vnodes: int = VNODES, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """Sorted (arc, shard) points; of two at one arc the smaller hash stays."""
    taken: dict[int, tuple[int, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            h = _point(f"{s}/{v}")
            at = h % buckets
            taken[at] = min(taken.get(at, (h, s)), (h, s))
    return sorted((at, s) for at, (_, s) in taken.items())


def flow(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = VNODES, buckets: int = BUCKETS) -> list[tuple[int, int, int, int, int]]:
    """(arc, from row, to row, shard, first slot) for the rows of every arc.

    Arcs arrive in a fixed scattered order, so that shards fill evenly.
    """
    total = sum(counts.values())
    room = [-(-int(total * (1 + slack)) // shards) if slack else total // shards + (s < total % shards) for s in range(shards)]
    points = ring(shards, vnodes, buckets)
    places = [at for at, _ in points]
    used, out = [0] * shards, []
    full_skip = list(range(len(points)))  # the next point that may have room

    def open_at(k: int) -> int:
        path = []
        for _ in range(len(points) + 1):
            if full_skip[k] == k:
                s = points[k][1]
                if used[s] < room[s]:
                    break
                full_skip[k] = (k + 1) % len(points)
            path.append(k)
            k = full_skip[k]
        for p in path:
            full_skip[p] = k
        return k

    for arc in sorted(counts, key=lambda a: (_point(f"arc {a}"), a)):
        done, k = 0, bisect.bisect_left(places, arc) % len(points)
        while done < counts[arc]:
            k = open_at(k)
            s = points[k][1]
            n = min(counts[arc] - done, room[s] - used[s])
            out.append((arc, done, done + n, s, used[s]))
            used[s] += n
            done += n
    return out


def place(key: Column, buckets: int = BUCKETS) -> Column:
    """The arc of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def shard(documents: DataFrame, shards: int = SHARDS, slack: float = 0.0, vnodes: int = VNODES, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, and its slot there (gapless from 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(F.col("doc_id").cast("long"), buckets).alias("arc"),
    )
    counts = documents.select(place(F.col("doc_id").cast("long"), buckets).alias("arc")).groupBy("arc").count()
    plan = flow({r[0]: r[1] for r in counts.collect()}, shards, slack, vnodes, buckets)
    table = documents.sparkSession.createDataFrame(plan, "arc int, low long, high long, shard int, first long")
    order = Window.partitionBy("arc").orderBy("doc_id", "text_crc32", "size")
    # One row for each arc and shard: its length has a constant bound, so it is broadcast.
    return (
        rows.withColumn("n", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(table), "arc")
        .where("low <= n and n < high")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - F.col("low")).alias("slot"))
    )
