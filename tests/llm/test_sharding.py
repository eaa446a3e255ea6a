import bisect
import zlib
from collections import Counter, defaultdict

import pytest

from seine.llm import sharding as s


def naive(counts, shards, slack, vnodes, buckets):
    """One key at a time, step by step clockwise."""
    total = sum(counts.values())
    room = [-(-int(total * (1 + slack)) // shards) if slack else total // shards + (i < total % shards) for i in range(shards)]
    points = s.ring(shards, vnodes, buckets)
    used, out = [0] * shards, {}
    for arc in sorted(counts, key=lambda a: (s._point(f"arc {a}"), a)):
        for n in range(counts[arc]):
            k = bisect.bisect_left([a for a, _ in points], arc) % len(points)
            while used[points[k][1]] >= room[points[k][1]]:
                k = (k + 1) % len(points)
            out[arc, n] = (points[k][1], used[points[k][1]])
            used[points[k][1]] += 1
    return out


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_flow_is_the_ring_walked_key_by_key(slack):
    counts = {a: (a * 7) % 5 for a in range(0, 64, 3)} | {5: 90}
    got = {(arc, n): (sh, first + n - low) for arc, low, high, sh, first in s.flow(counts, 5, slack, 4, 64) for n in range(low, high)}
    assert got == naive(counts, 5, slack, 4, 64)


def test_more_shards_move_few_rows():
    counts = {a: 3 for a in range(s.BUCKETS)}
    def owners(k):
        return {(arc, n): sh for arc, low, high, sh, _ in s.flow(counts, k, 0.1) for n in range(low, high)}
    a, b = owners(24), owners(25)
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


def check(rows, texts, shards):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_rows(spark):
    texts = [(i, "same") for i in range(300)] + [(7, "same")] * 50 + [(None, None), (-1, None), (400, ""), (401, "é" * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, shard int, arc string")
    out = s.shard(df)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    check(out.collect(), texts, 24)
    assert s.shard(df.limit(0)).count() == 0


def test_query(spark):
    from seine.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op10_shard"](spark, sf).collect()
    check(rows, texts, 24)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
