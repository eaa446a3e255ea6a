"""The trigram index: build, open, freshness, deltas, compaction, candidates.

An index is a folder of generations. A generation holds segments, each with a
``manifest`` (one row for each file id), ``postings`` (tri, file_id; ranged and
sorted by trigram, so that row-group statistics serve look-ups, and delta-coded,
as neighbours differ little) and ``stats`` (tri, df); a pointer file, written
last, names the current one. Ids are never reused: a changed file is a tombstone
and a new id.

A build reads every content once: what comes out of it, a file's flags and
distinct trigrams, is written next to the index, so contents are never shuffled
and ids need no order of the paths. Postings are rows nowhere on the way: those
of a run of files are three arrays, cut at the bounds of ranges of trigrams that
hold about ``RANGE`` postings each; one task sorts and writes a range.

One writer at a time holds the lock. Whoever finds it taken answers from the
index as it is, with the files that are new or changed as candidates of their
own; where there is no index yet, all files are candidates.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.sources import shared

VERSION = 2
#: Bytes above which a file is searched always, not indexed.
TOO_LARGE = 16 << 20
BINARY_WINDOW = 64 << 10
#: Share of the main postings that a delta may reach before all is rebuilt.
COMPACT = 0.1
#: Postings of a run of files in one task, and (about) of a range of trigrams.
RUN, RANGE = 1 << 20, 4 << 20
#: Rows of a group of postings, of which a look-up reads few.
GROUP = 1 << 18
#: Bits of a file id: with the 24 of a trigram they are a positive number.
_ID = 38
#: Seconds after which a lock is taken for that of a dead writer.
STALE = 6 * 3600
_FLAGS = ("too_large", "transcode", "is_binary", "nul_late")
#: Delta coding of integer columns needs the second page format and no dictionary.
_DELTA = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


class Busy(RuntimeError):
    """Another writer holds the lock."""


def classify(files: DataFrame, cap: int = TOO_LARGE) -> DataFrame:
    """``too_large``, ``transcode`` (a UTF-16 mark), ``is_binary`` (early NUL), ``nul_late`` of (path, content)."""
    raw = F.col("content").cast("binary")
    nul = F.locate("\x00", F.col("content").cast("string"))
    mark = F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF")
    large = F.octet_length(raw) > cap
    return files.withColumns({
        "too_large": large, "transcode": ~large & mark,
        "is_binary": ~large & ~mark & (nul > 0) & (nul <= BINARY_WINDOW), "nul_late": ~large & ~mark & (nul > BINARY_WINDOW),
    })


def _distinct(raw: pa.Buffer | None, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct trigrams of some bytes in order; ``among`` tells for each trigram whether it counts."""
    a = np.frombuffer(raw or b"", np.uint8).astype(np.int32)
    if len(a) < 3:
        return np.zeros(0, np.int32)
    tri = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
    tri = tri if among is None else tri[among[tri]]
    tri.sort()
    return tri[_first(tri)]


def _first(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def postings(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(tri, file_id): the distinct byte trigrams of every content, straight from its bytes; only those ``wanted``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = None
        if wanted is not None:
            among = np.zeros(1 << 24, bool)
            among[wanted] = True
        for batch in batches:
            ids, some, n = [], [], 0
            for key, value in zip(batch.column("file_id").to_pylist(), batch.column("content")):
                tri = _distinct(value.as_buffer(), among)
                ids.append(np.full(len(tri), key, np.int64))
                some.append(tri)
                n += len(tri)
                if n >= GROUP:
                    yield pa.record_batch([pa.array(np.concatenate(some)), pa.array(np.concatenate(ids))], names=["tri", "file_id"])
                    ids, some, n = [], [], 0
            if n:
                yield pa.record_batch([pa.array(np.concatenate(some)), pa.array(np.concatenate(ids))], names=["tri", "file_id"])

    shared.bounded(files.sparkSession)
    return files.where("content is not null").select("file_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, "tri int, file_id long")


_RUNS = "tri binary, n binary, at binary"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without their ``content``; the first of a run of rows has the run's postings.

    These are the distinct trigrams in order, how many files have each, and for
    each posting its file's ``_n`` less that of the first.
    """
    held, some, rows, count, low = [], [], [], 0, 0

    def run() -> pa.RecordBatch:
        lone = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        tri = np.concatenate(some) if some else np.zeros(0, np.int32)
        key = tri.astype(np.int64) << 16 | np.repeat(np.array(rows, np.int64), [len(t) for t in some])
        key.sort()
        tri, at = (key >> 16).astype(np.int32), (key & 0xFFFF).astype(np.uint16)
        own = np.flatnonzero(_first(tri))
        n = np.diff(np.append(own, len(tri))).astype(np.int32)
        blobs = [pa.array([x.tobytes() if len(own) else None, *[None] * (lone.num_rows - 1)], pa.binary()) for x in (tri[own], n, at)]
        return pa.RecordBatch.from_arrays([*lone.columns, *blobs], names=[*lone.schema.names, "tri", "n", "at"])

    for batch in batches:
        skip = np.zeros(batch.num_rows, bool)
        for flag in ("too_large", "transcode", "is_binary"):
            skip |= batch.column(flag).to_numpy(zero_copy_only=False)
        lone, begun = batch.drop_columns(["content"]), 0
        for k, (no, n, value) in enumerate(zip(skip.tolist(), batch.column("_n").to_pylist(), batch.column("content"))):
            if (held or k > begun) and (count >= RUN or n - low > 0xFFFF):
                held += [lone.slice(begun, k - begun)] if k > begun else []
                yield run()
                held, some, rows, count, begun = [], [], [], 0, k
            if not held and k == begun:
                low = n
            if not no and value.is_valid:
                some.append(_distinct(value.as_buffer()))
                rows.append(n - low)
                count += len(some[-1])
        if batch.num_rows > begun:
            held.append(lone.slice(begun))
    if held:
        yield run()


def _merged(tri: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``n`` for each of the trigrams."""
    t, m = np.concatenate(tri), np.concatenate(n).astype(np.int64)
    order = np.argsort(t, kind="stable")
    t, m = t[order], m[order]
    own = np.flatnonzero(_first(t))
    return t[own], np.add.reduceat(m, own) if len(own) else m


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tri, df) of all runs of a task."""
    tri, n, size = [], [], 0
    for batch in batches:
        for t, m in zip(batch.column("tri"), batch.column("n")):
            tri.append(np.frombuffer(t.as_buffer(), np.int32).copy())
            n.append(np.frombuffer(m.as_buffer(), np.int32).copy())
            size += len(tri[-1])
            if size > RANGE:
                t, m = _merged(tri, n)
                tri, n, size = [t], [m], 0
    if tri:
        t, m = _merged(tri, n)
        for k in range(0, len(t), GROUP):
            yield pa.record_batch([pa.array(t[k : k + GROUP]), pa.array(m[k : k + GROUP])], names=["tri", "df"])


def _ranges(stats: DataFrame) -> list[tuple[int, int]]:
    """(first trigram, parts) of ranges of about ``RANGE`` postings; a trigram with more is a range of parts.

    To the driver come sums by the first two bytes, and of those that are too
    much for a range the trigrams.
    """
    pair = F.shiftright("tri", 8)
    units = {(r.p << 8): r.df for r in stats.groupBy(pair.alias("p")).agg(F.sum("df").alias("df")).collect()}
    heavy = [p for p, n in units.items() if n > RANGE]
    if heavy:
        fine = stats.join(F.broadcast(stats.sparkSession.createDataFrame([(p >> 8,) for p in heavy], "p int")), pair == F.col("p"), "left_semi")
        for p in heavy:
            del units[p]
        units |= {r.tri: r.df for r in fine.select("tri", "df").collect()}
    out: list[tuple[int, int]] = []
    size = RANGE + 1
    for first, n in sorted(units.items()):
        if size + n > RANGE:
            out.append((first, -(-n // RANGE)))
            size = 0
        size += n
    return out


def _cut(ranges: list[tuple[int, int]], ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs (file_id of the first row, tri, n, at) as their pieces by range; ``ids`` is above all file ids."""
    starts, parts = np.array([r[0] for r in ranges], np.int64), [r[1] for r in ranges]
    bucket = np.cumsum([0, *parts]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, *blobs in zip(batch.column("file_id").to_pylist(), *(batch.column(c) for c in ("tri", "n", "at"))):
                tri, n, at = (np.frombuffer(b.as_buffer(), kind) for b, kind in zip(blobs, (np.int32, np.int32, np.uint16)))
                edge, ends = [*np.searchsorted(tri, starts).tolist(), len(tri)], np.concatenate([[0], np.cumsum(n)])
                out = []
                for k, many in enumerate(parts):
                    a, b = edge[k], edge[k + 1]
                    if a == b:
                        continue
                    own = at[ends[a] : ends[b]]
                    if many == 1:
                        out.append((bucket[k], base, tri[a:b].tobytes(), n[a:b].tobytes(), own.tobytes()))
                        continue
                    part = (own.astype(np.int64) + base) * many // ids  # of one trigram, by file
                    for j in np.unique(part).tolist():
                        some = own[part == j]
                        out.append((bucket[k] + j, base, tri[a:b].tobytes(), np.array([len(some)], np.int32).tobytes(), some.tobytes()))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "base", "tri", "n", "at"])

    return run


def _sorted(to: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the pieces of each range as a sorted file below ``to``; a repeated task writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, base, *blobs in zip(batch.column("bucket").to_pylist(), batch.column("base").to_pylist(), *(batch.column(c) for c in ("tri", "n", "at"))):
                tri, n, at = (np.frombuffer(b.as_buffer(), kind) for b, kind in zip(blobs, (np.int32, np.int32, np.uint16)))
                keys.setdefault(bucket, []).append(np.repeat(tri.astype(np.int64) << _ID, n) | (at.astype(np.int64) + base))
        for bucket in sorted(keys):
            key = np.concatenate(keys.pop(bucket))
            key.sort()
            _put(to, f"part-{bucket:06d}.parquet", key)
            yield pa.record_batch([pa.array([len(key)], pa.int64())], names=["n"])

    return run


def _put(to: str, name: str, key: np.ndarray) -> None:
    """Postings as a file, seen only when it is whole."""
    fs, local = pafs.FileSystem.from_uri(to) if "://" in to else (pafs.LocalFileSystem(), to)
    fs.create_dir(local)
    new = f"{local}/_{name}.{uuid.uuid4().hex}"
    schema = pa.schema([("tri", pa.int32()), ("file_id", pa.int64())])
    coded = {"use_dictionary": False, "column_encoding": {"tri": "DELTA_BINARY_PACKED", "file_id": "DELTA_BINARY_PACKED"}, "compression": "zstd", "data_page_version": "2.0"}
    with pq.ParquetWriter(new, schema, filesystem=fs, **coded) as out:
        for k in range(0, len(key), GROUP):
            some = key[k : k + GROUP]
            out.write_batch(pa.record_batch([pa.array((some >> _ID).astype(np.int32)), pa.array(some & (1 << _ID) - 1)], schema=schema))
    if not isinstance(fs, pafs.LocalFileSystem):  # others don't move onto a file
        with suppress(FileNotFoundError):
            fs.delete_file(f"{local}/{name}")
    fs.move(new, f"{local}/{name}")


class Index:
    """An index below ``path`` over a corpus (path, content, mtime, size)."""

    def __init__(self, spark: SparkSession, path: str, cap: int = TOO_LARGE) -> None:
        self.spark, self.path, self.cap = spark, path.rstrip("/"), cap
        self.fs, self.local = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), self.path)
        #: Paths that are new or changed since the last writer's sweep, while its lock is held.
        self.extras: DataFrame | None = None
        self.gone: DataFrame | None = None
        self.no_index = False

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Hold the writers' lock; ``Busy`` if another does."""
        at = f"{self.local}/lock"
        self.fs.create_dir(self.local)
        if isinstance(self.fs, pafs.LocalFileSystem):
            with suppress(FileNotFoundError):
                if time.time() - os.stat(at).st_mtime > STALE:
                    os.unlink(at)
            try:
                os.close(os.open(at, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                raise Busy(f"{self.path} is being written") from None
        else:  # no exclusive creation: a commit checks the generation it began from as well
            if self.fs.get_file_info(at).type != pafs.FileType.NotFound:
                raise Busy(f"{self.path} is being written")
            with self.fs.open_output_stream(at):
                pass
        try:
            yield
        finally:
            self.fs.delete_file(at)

    def meta(self) -> dict | None:
        """The pointer, or None where there is no index of this version."""
        try:
            with self.fs.open_input_stream(f"{self.local}/current.json") as f:
                meta = json.loads(f.read())
        except FileNotFoundError:
            return None
        return meta if meta.get("version") == VERSION else None

    def _commit(self, was: dict | None, **meta) -> None:
        """Write the pointer, unless another writer has since ``was`` was read."""
        if (self.meta() or {}).get("serial") != (was or {}).get("serial"):
            raise Busy(f"{self.path} was written meanwhile")
        new = f"{self.local}/current.json.{os.getpid()}.{threading.get_ident()}"
        with self.fs.open_output_stream(new) as f:
            f.write(json.dumps({"version": VERSION, **meta, "serial": time.time_ns()}).encode())
        self.fs.move(new, f"{self.local}/current.json")

    def _write(self, files: DataFrame, to: str, first: int) -> tuple[int, int, int]:
        """Manifest, postings and their counts for files; returns the next id, the files searched always, and the postings."""
        columns = ["path", "mtime", "size", *_FLAGS]
        source = classify(files, self.cap).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_n"))
        source = source.select(*columns, "_part", "_n", F.col("content").cast("binary").alias("content"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "content")
        shared.bounded(self.spark)
        source.mapInArrow(_grams, f"{kinds}, {_RUNS}").write.options(compression="zstd").parquet(f"{to}/staged")
        staged = self.spark.read.parquet(f"{to}/staged")
        at, rows = first, []
        # One row a task.
        for r in staged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_n").alias("low")).orderBy("_part").collect():
            rows.append((r["_part"], at - r["low"]))
            at += r["n"]
        shift = self.spark.createDataFrame(rows, "_part int, shift long")
        staged = staged.join(F.broadcast(shift), "_part").withColumn("file_id", F.col("_n") + F.col("shift"))
        staged.select("file_id", *columns).write.parquet(f"{to}/manifest")
        runs = staged.where("tri is not null")
        stats = runs.select("tri", "n").mapInArrow(_counts, "tri int, df long").groupBy("tri").agg(F.sum("df").alias("df"))
        stats.sortWithinPartitions("tri").write.options(**_DELTA).parquet(f"{to}/stats")
        stats = self.spark.read.parquet(f"{to}/stats")
        ranges, total = _ranges(stats), stats.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        if ranges:
            pieces = runs.select("file_id", "tri", "n", "at").mapInArrow(_cut(ranges, at), f"bucket int, base long, {_RUNS}")
            done = pieces.repartitionById(sum(r[1] for r in ranges), "bucket").mapInArrow(_sorted(f"{to}/postings"), "n long")
            if (wrote := done.agg(F.sum("n")).first()[0]) != total:
                raise RuntimeError(f"{wrote} postings were written of {total}")
        else:
            _put(f"{to}/postings", "part-000000.parquet", np.zeros(0, np.int64))
        self.fs.delete_dir((to if "://" not in to else pafs.FileSystem.from_uri(to)[1]) + "/staged")
        always = F.coalesce(F.sum(reduce(Column.__or__, map(F.col, _FLAGS)).cast("long")), F.lit(0))
        return at, self.spark.read.parquet(f"{to}/manifest").agg(always).first()[0], total

    def build(self, corpus: DataFrame) -> Index:
        """A new generation of everything."""
        with self.lock():
            return self._build(corpus)

    def _build(self, corpus: DataFrame) -> Index:
        was, gen = self.meta(), str(time.time_ns())
        self.fs.create_dir(f"{self.local}/{gen}")
        nxt, always, total = self._write(corpus, f"{self.path}/{gen}/0", 0)
        self._commit(was, generation=gen, segments=["0"], sizes=[total], always=always, dead=[], next_id=nxt, swept=time.time())
        self.extras = self.gone = None
        self.no_index = False
        if was:  # readers of the old generation that have not begun will find the new one
            with suppress(FileNotFoundError):
                self.fs.delete_dir(f"{self.local}/{was['generation']}")
        return self

    def open(self, corpus: DataFrame, ttl: float = 0, under: str = "") -> Index:
        """Build where there is none, else bring up to date (unless swept within ``ttl`` seconds).

        While another writer is at it, the index stays as it is: see ``extras``.
        """
        meta = self.meta()
        if meta and ttl > 0 and time.time() - meta["swept"] <= ttl:
            return self
        try:
            return self.update(corpus, under) if meta else self.build(corpus)
        except Busy:
            self.no_index = self.meta() is None
            if not self.no_index:
                diff = freshness(corpus, self.manifest()).where(_inside(under) if under else F.lit(True))
                self.extras = diff.where("status in ('new', 'changed')").select("path")
                self.gone = diff.where("status in ('dead')").select("path")
            return self

    def open_later(self, corpus: DataFrame, least_bytes: int = 64 << 20) -> threading.Thread | None:
        """As ``open``, but a first build of much is done beside: until then all files are candidates."""
        if self.meta() is not None:
            self.open(corpus)
            return None
        if (corpus.agg(F.sum("size")).first()[0] or 0) < least_bytes:
            self.open(corpus)
            return None
        self.no_index = True
        beside = threading.Thread(target=lambda: Index(self.spark, self.path, self.cap).open(corpus), name="first-build")
        beside.start()
        return beside

    def _all(self, table: str) -> DataFrame:
        meta = self.meta()
        parts = [f"{self.path}/{meta['generation']}/{s}/{table}" for s in meta["segments"]]
        return self.spark.read.parquet(*parts)

    def manifest(self) -> DataFrame:
        """Live files."""
        meta = self.meta()
        m = self._all("manifest")
        if meta["dead"]:
            dead = self.spark.read.parquet(*(f"{self.path}/{meta['generation']}/{d}" for d in meta["dead"]))
            m = m.join(dead, "file_id", "left_anti")
        return m

    def postings(self) -> DataFrame:
        return self._all("postings")

    def append(self, corpus: DataFrame) -> Index:
        """As ``update``, but files that the corpus lacks stay as they are."""
        return self.update(corpus, whole=False)

    def update(self, corpus: DataFrame, under: str = "", whole: bool = True) -> Index:
        """Tombstones and one more segment for what changed; a rebuild once deltas weigh ``COMPACT``."""
        with self.lock():
            return self._update(corpus, under, whole)

    def _update(self, corpus: DataFrame, under: str, whole: bool) -> Index:
        meta = self.meta()
        live = self.manifest()
        if under:
            corpus, live = corpus.where(_inside(under)), live.where(_inside(under))
        diff = freshness(corpus, live)
        if not whole:
            diff = diff.where("status <> 'dead'")
        swept = meta["swept"] if under or not whole else time.time()
        if diff.where("status <> 'same'").isEmpty():
            self._commit(meta, **{k: v for k, v in meta.items() if k not in ("version", "serial")} | {"swept": swept})
            return self
        gen, name = f"{self.path}/{meta['generation']}", str(len(meta["segments"]))
        dead = f"dead-{name}-{time.time_ns()}"
        diff.where("status in ('changed', 'dead')").select("file_id").write.parquet(f"{gen}/{dead}")
        fresh = corpus.join(diff.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
        name = f"{name}-{time.time_ns()}"
        nxt, always, total = self._write(fresh, f"{gen}/{name}", meta["next_id"])
        new = {"segments": [*meta["segments"], name], "sizes": [*meta["sizes"], total], "always": meta["always"] + always, "dead": [*meta["dead"], dead], "next_id": nxt, "swept": swept}
        self._commit(meta, **{k: v for k, v in meta.items() if k not in ("version", "serial")} | new)
        self.extras = self.gone = None
        if not under and whole and sum(new["sizes"][1:]) > COMPACT * new["sizes"][0]:
            return self._build(corpus)
        return self

    def status(self) -> DataFrame:
        """One row: files, skipped (binary, oversized, to be transcoded) and the second of the last sweep."""
        skip = F.col("too_large") | F.col("transcode") | F.col("is_binary")
        counted = self.manifest().agg(F.count("*").alias("files"), F.coalesce(F.sum(skip.cast("long")), F.lit(0)).alias("skipped"))
        return counted.withColumn("last_sweep", F.lit(int(self.meta()["swept"])))

    def has_files_under(self, folder: str) -> bool:
        """Whether any live file is at or below a path."""
        return not self.manifest().where(_inside(folder)).isEmpty()

    def binary_files(self) -> DataFrame:
        """(path) of the live files with a NUL."""
        return self.manifest().where("is_binary or nul_late").select("path")

    def _frequencies(self, wanted: list[int]) -> dict[int, int]:
        """Files that have each of some trigrams (a number that the planner bounds), without a job."""
        meta, df = self.meta(), dict.fromkeys(wanted, 0)
        for s in meta["segments"]:
            table = pads.dataset(f"{self.local}/{meta['generation']}/{s}/stats", filesystem=self.fs, format="parquet")
            for row in table.to_table(filter=pads.field("tri").isin(wanted)).to_pylist():
                df[row["tri"]] += row["df"]
        return df

    def candidates(self, groups: list[list[list[int]]] | None, binary: bool = False, rarest: int = 4, zipped: bool = False) -> DataFrame:
        """(path) of the live files that may match a plan, and of those that are searched always."""
        if self.no_index:
            raise LookupError("there is no index yet: all files are candidates")
        live = self.manifest()
        if groups is None:
            out = live.where("not is_binary" if not binary else "true").select("path")
        else:
            meta, wanted = self.meta(), sorted({s for g in groups for t in g for s in t})
            ids = narrowed(self.postings(), groups, self._frequencies(wanted), rarest)
            out = live.join(ids, "file_id", "left_semi").select("path")
            always = F.col("too_large") | F.col("transcode") | F.col("nul_late") | (F.col("is_binary") if binary else F.lit(False))
            always |= F.col("path").endswith(".gz") if zipped else F.lit(False)
            if meta["always"] or zipped:
                out = out.union(live.where(always).select("path")).distinct()
        if self.extras is not None:
            out = out.union(self.extras).distinct().join(self.gone, "path", "left_anti")
        return out


def _inside(folder: str) -> Column:
    folder = folder.strip("/")
    return F.lit(True) if folder in ("", ".") else F.col("path").startswith(folder + "/") | (F.col("path") == folder)


def narrowed(tri_postings: DataFrame, groups: list[list[list[int]]], df: dict[int, int] | None = None, rarest: int = 4) -> DataFrame:
    """(file_id) that have, for some group, a spelling of each of its trigrams.

    Of a group only the ``rarest`` trigrams are looked up (fewer conditions only
    widen the candidates); a trigram that no file has ends its group. One
    grouping by file tells which trigrams of the plan it has.
    """
    if df is not None:
        cost = lambda t: sum(df.get(s, 0) for s in t)
        groups = [sorted(g, key=cost)[:rarest] for g in groups if all(map(cost, g))]
    needs = sorted({tuple(t) for g in groups for t in g})
    used = sorted({s for t in needs for s in t})
    if not groups:
        return tri_postings.where(F.lit(False)).select("file_id")
    hits = tri_postings.where(F.col("tri").isin(used))
    if len(groups) == 1 and all(len(t) == 1 for t in needs):  # a posting is there once
        return hits.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(needs)).select("file_id")
    # Many needs are told by the bits of a few integers.
    word = {t: divmod(k, 62) for k, t in enumerate(needs)}
    words = -(-len(needs) // 62)
    masks: dict[int, list[int]] = {s: [0] * words for s in used}
    for t in needs:
        for s in t:
            masks[s][word[t][0]] |= 1 << word[t][1]
    names = [f"m{w}" for w in range(words)]
    table = tri_postings.sparkSession.createDataFrame([(s, *m) for s, m in masks.items()], ", ".join(["tri int", *(f"{n} long" for n in names)]))
    have = hits.join(F.broadcast(table), "tri").groupBy("file_id").agg(*[F.bit_or(n).alias(n) for n in names])
    ok = []
    for g in groups:
        all_of: dict[int, int] = {}
        for t in g:
            w, b = word[tuple(t)]
            all_of[w] = all_of.get(w, 0) | 1 << b
        ok.append(reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(b)) == F.lit(b) for w, b in all_of.items()]))
    return have.where(reduce(Column.__or__, ok)).select("file_id")


def freshness(corpus: DataFrame, live: DataFrame) -> DataFrame:
    """(path, file_id, status) of a snapshot against the live manifest: new, changed, dead or same."""
    now = corpus.select("path", F.col("mtime").alias("now_mtime"), F.col("size").alias("now_size"), F.lit(True).alias("here"))
    old = live.select("path", "file_id", "mtime", "size")
    both = now.join(old, "path", "full_outer")
    same = F.col("now_mtime").eqNullSafe(F.col("mtime")) & F.col("now_size").eqNullSafe(F.col("size"))
    status = F.when(F.col("file_id").isNull(), "new").when(F.col("here").isNull(), "dead").when(same, "same").otherwise("changed")
    return both.select("path", "file_id", status.alias("status"))
