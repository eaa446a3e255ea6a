"""Near-duplicate groups: MinHash bands, exact verification, connected components.

1. One pass over the texts gives each document's set of word shingles (as
   64-bit hashes), a 128-bit digest of the whole set, and ``BANDS * ROWS``
   minima of universal hashes (multiply and add modulo 2^64), folded into bands.
2. Documents of equal sets form one class; its smallest id stands for it from
   here on, so thousands of exact copies are one node.
3. Nodes that share a band are candidates. Each bucket gives the pairs with its
   smallest node (a star, not all pairs); pairs whose set sizes rule a link out
   are dropped; the others are confirmed on full sets. A key that a sample shows
   to be hot is salted: its parts are stars of their own, and their smallest
   nodes are compared too.
4. Links are joined into components by alternating large-star and small-star.
5. Where a bucket still spans several components, pairs across them are
   confirmed too, so no link between its members is lost; then components are
   formed anew. In a bucket of up to ``SMALL`` nodes these are all such pairs.
   Nodes of larger buckets (texts that share a footer, say) meet by rarity
   instead: two sets that are similar enough have a hash in common among the
   rarest of the larger and the (fewer) rarest of the smaller, so only those are
   joined. Rarity is any fixed order to be exact; it is taken from counts in a
   table of constant size, so that shared passages come last.

A pair at the threshold shares no band with probability
``(1 - t ** ROWS) ** BANDS`` (1e-7 at 0.8), the only chance of a loss. Pairs in
a large bucket are many only if each shares about eight ninths of its text with
the others and yet is not linked with them.

Defined cases: a null or empty text has no shingles and is linked with nothing;
fewer words than a shingle make one shingle; rows of equal ids are one document
(their links are joined; each row is returned); a row without an id is linked
with nothing and kept; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.llm.session import Tables, ids_and_texts, tune
from seine.llm.text import NONSPACE, Words, mix, pieces, words

BANDS, ROWS = 40, 5
#: Ids of a set of documents are broadcast up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Largest bucket of which all pairs across components are formed.
SMALL = 64
#: One of so many classes is sampled to find hot keys; with so many in the sample a key is salted into so many parts.
SAMPLE, HOT, SALTS = 64, 64, 64
#: Most hot keys (of 8 bytes) that are broadcast; beyond it the least number that makes a key hot is raised.
HOT_KEYS = 100_000
#: Bits of the counts by which hashes are ordered: their number is the same for every input.
RARITY_BITS = 20
_PIECE = 1 << 20
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_C = np.uint64(0xD6E8FEB86659FD93)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and each row's range."""
    n = len(w.first) - 1
    count = np.diff(w.first)
    acc = mix(w.hash * _C)
    short = acc.copy()
    for t in range(1, size):
        ok = np.zeros(len(acc), bool)
        m = max(0, len(acc) - t)
        ok[:m] = w.row[t:] == w.row[:m]
        nxt = np.zeros_like(acc)
        nxt[:m] = w.hash[t:]
        acc = np.where(ok, mix(acc * _C + nxt), acc)
        short = acc
    last = w.first[1:][w.row] - size  # a row's last whole shingle begins here
    begin = np.arange(len(acc)) <= np.maximum(last, w.first[:-1][w.row])
    h, row = short[begin], w.row[begin]
    at = np.concatenate([[0], np.cumsum(np.where(count > 0, np.maximum(count - size + 1, 1), 0))])
    parts = [np.unique(h[at[r] : at[r + 1]]) for r in range(n)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else h), first


def bands(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band hashes (rows by ``BANDS``) of non-empty sets."""
    start = first[:-1]
    out = np.zeros((len(start), BANDS), np.uint64)
    y = np.empty_like(h)
    for k in range(BANDS):
        acc = np.full(len(start), k, np.uint64)
        for i in range(k * ROWS, (k + 1) * ROWS):
            np.multiply(h, _A[i], out=y)
            np.add(y, _B[i], out=y)
            acc = mix(acc * _C + np.minimum.reduceat(y, start))
        out[:, k] = acc
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                h, first = shingles(words(part.column("text"), NONSPACE), size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                keys: list = [None] * part.num_rows
                digest: list = [None] * part.num_rows
                if len(full):
                    table = bands(h, np.append(first[full], first[-1])).view(np.int64)
                    for r, row in zip(full.tolist(), table):
                        keys[r] = row
                        digest[r] = hashlib.blake2b(h[first[r] : first[r + 1]].tobytes(), digest_size=16).digest()
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                h, first = shingles(words(part.column("text"), NONSPACE), size)
                yield pa.record_batch([part.column("doc_id"), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["node", "hashes"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            held, a = None, np.zeros(0, np.uint64)
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = x.as_buffer(), y.as_buffer()
                if held is None or not held.equals(x):
                    held, a = x, np.frombuffer(x, np.uint64)
                b = np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[k] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def restricted(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` is (or, ``left_anti``, isn't) among ``ids.node``.

    The ids are broadcast where their count, taken first, proves them small.
    """
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, rows[column] == ids["node"], how)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as ``percent`` says."""
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that isn't the smallest of its component.

    Alternating large-star and small-star over ``edges`` (a, b); every minimum is
    pre-aggregated, and each round's edges are a written table.
    """
    tables = Tables(edges.sparkSession)
    e = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (now := _checksum(e)) != before:
        before = now
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.write(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = tables.write(small.where("u <> v").distinct(), "edges")
        tables.drop(e, large)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _possible(percent: int, x: str, y: str):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _hot(named: DataFrame, sample: int, hot: int) -> DataFrame:
    """(key) that very many classes have, by a sample of the classes; the sample decides on salting alone."""
    part = named.where(F.pmod(F.xxhash64("digest"), F.lit(sample)) == 0).dropDuplicates(["digest"])
    least = max(hot, -(-part.count() * BANDS // HOT_KEYS))
    keys = part.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return keys.where(F.col("n") >= least).select("key", F.lit(True).alias("hot"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of a task's hashes."""
    count = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for x in batch.column("hashes"):
            count += np.bincount(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - RARITY_BITS), minlength=len(count))
    slot = np.flatnonzero(count)
    yield pa.record_batch([pa.array(slot, pa.int64()), pa.array(count[slot])], names=["slot", "n"])


def _rarest(percent: int, count: np.ndarray):
    """The hashes by which a set meets others: its rarest, ``first`` for those that serve it as the smaller set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, component = batch.column("node").to_pylist(), batch.column("component").to_pylist()
            for k, x in enumerate(batch.column("hashes")):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(h)
                # A set of n and a larger one have in common at least 2t / (1 + t) of n; a larger one of m, at least t of m.
                probe, index = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
                h = h[np.lexsort((h, count[h >> np.uint64(64 - RARITY_BITS)]))[:probe]]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(np.full(len(h), node[k])), pa.array(np.full(len(h), n)), pa.array(np.full(len(h), component[k])), pa.array(np.arange(len(h)) < index)],
                    names=["hash", "node", "n", "component", "first"],
                )

    return run


def _by_rarity(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates of different components among (node, hashes, component)."""
    counted = sets.select("hashes").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1 << RARITY_BITS, np.int64)
    count[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    rows = sets.mapInArrow(_rarest(percent, count), "hash long, node long, n long, component long, first boolean")
    x, y = rows.where("first").alias("x"), rows.alias("y")
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, (F.col("x.hash") == F.col("y.hash")) & order & (F.col("x.component") != F.col("y.component")) & _possible(percent, "x.n", "y.n"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def groups(documents: DataFrame, shingle: int = 5, percent: int = 80, small: int = SMALL, sample: int = SAMPLE, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    tables = Tables(tune(documents.sparkSession))
    docs = ids_and_texts(documents)
    sig = tables.write(docs.mapInArrow(_signatures(shingle), "doc_id long, n long, digest binary, bands array<long>"), "signatures", by="digest")
    named = sig.where("doc_id is not null and n > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.first("n").alias("n"))

    # ``part`` is the key, or one of the parts of a hot key, which ``hot_key`` names.
    exploded = classes.select("node", "n", F.explode("bands").alias("key")).join(F.broadcast(_hot(named, sample, hot)), "key", "left")
    salted = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    exploded = exploded.select("node", "n", F.when(F.col("hot"), F.col("key")).alias("hot_key"), F.when(F.col("hot"), salted).otherwise(F.col("key")).alias("part"))
    part = Window.partitionBy("part")
    hub = F.min(F.struct("node", "n")).over(part).alias("hub")
    buckets = tables.write(exploded.select("part", "hot_key", "node", "n", hub, F.count("*").over(part).alias("size")).where("size > 1 or hot_key is not null"), "buckets", by="node")
    # At most HOT_KEYS * SALTS rows.
    hubs = buckets.where("hot_key is not null").groupBy("hot_key", "part").agg(F.first("hub").alias("hub"))
    tops = hubs.join(hubs.groupBy("hot_key").agg(F.min("hub").alias("top")), "hot_key").select("top", F.col("hub.node").alias("node"), F.col("hub.n").alias("n"))
    stars = buckets.select(F.col("hub").alias("top"), "node", "n").union(tops).where(F.col("node") != F.col("top.node")).where(_possible(percent, "n", "top.n"))
    pairs = tables.write(stars.select(F.col("top.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = tables.write(restricted(docs, nodes, "doc_id").mapInArrow(_sets(shingle), "node long, hashes binary"), "sets", by="node")
    links = tables.write(_confirmed(pairs, sets, percent), "links", by="a")
    member = named.select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    # Texts of one id are one document, whatever classes they are of.
    repeated = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    same = tables.write(member.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "same")
    comp = components(links.union(same))

    bucket = F.coalesce("hot_key", "part").alias("bucket")
    several = buckets.where("size > 2 or hot_key is not null").join(comp, "node", "left").select(bucket, "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = several.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("bucket", "size")
    rest = tables.write(several.join(mixed, "bucket"), "rest")
    few = rest.where(F.col("size") <= small)
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _possible(percent, "x.n", "y.n"))
    across = tables.write(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    wide = tables.write(rest.where(F.col("size") > small).groupBy("node").agg(F.first("component").alias("component")), "wide")
    nodes = across.select(F.explode(F.array("a", "b")).alias("node")).union(wide.select("node")).distinct().join(sets, "node", "left_anti")
    nodes = tables.write(nodes, "nodes")
    more = tables.write(restricted(docs, nodes, "doc_id").mapInArrow(_sets(shingle), "node long, hashes binary"), "sets", by="node")
    every = sets.union(more)
    tables.drop(buckets, rest)
    if not wide.isEmpty():
        met = _by_rarity(every.join(wide, "node"), percent).join(pairs, ["a", "b"], "left_anti")
        met = tables.write(across.union(met).distinct(), "pairs")
        tables.drop(across)
        across = met
    found = tables.write(_confirmed(across, every, percent), "links", by="a")
    if not found.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    tables.drop(pairs, links, same, sets, more, nodes, wide, across, found)

    of = member.join(comp, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    out = sig.select("doc_id", "n").join(of, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group (its smallest id); all columns stay."""
    gone = groups(documents, shingle, percent).where("not kept").select(F.col("doc_id").alias("node"))
    return restricted(documents, Tables(documents.sparkSession).write(gone.distinct(), "removed"), "doc_id", "left_anti")
