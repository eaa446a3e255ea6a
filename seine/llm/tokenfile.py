"""Fixed-width bit packing of token ids, with block offsets for random access.

A file holds blocks of ``BLOCK`` ids, each id in the fewest bits that hold the
vocabulary, then a footer: ids and ends of the documents, offsets of the
blocks, and a fixed trailer that says where these are. A block is unpacked by
one vectorised expression, and any range of ids from its blocks alone.

    blocks | doc ids int64[] | ends int64[] | block offsets int64[] |
    trailer: documents, tokens, blocks, block size, width, end id (int64), magic

Tasks write one file each, under a name of their own attempt, to the shared
folder; only files of attempts that ended are in the manifest.

Defined cases: a null or empty text is the end id alone; a null id is stored as
the least of 64 bits and read back as null; repeated ids keep one entry for each
row, in order of their texts' hashes; no documents give no file. One document's
ids are held whole as they are encoded; they are read back in steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.session import filesystem, ids_and_texts, in_order, scratch, tune
from seine.llm.text import pieces
from seine.llm.tokens import encoder

MAGIC = b"SEINEBP1"
BLOCK = 1 << 16
_TRAILER = 6 * 8 + len(MAGIC)
_STEP = 1 << 20
#: What a file has for a null id.
NO_ID = -(2**63)


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype("<u4")
    data = np.frombuffer(raw + b"\0" * 8, np.uint8)
    at = np.arange(n, dtype=np.int64) * width
    eight = np.ndarray((len(raw) + 1,), "<u8", data.data, 0, (1,))
    return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


class Writer:
    """Appends documents to a stream; ``close`` writes the footer."""

    def __init__(self, stream, vocabulary: int, end_id: int, block: int = BLOCK) -> None:
        self.stream, self.width, self.end_id, self.block = stream, width_of(vocabulary), end_id, block
        self.open: list[np.ndarray] = []
        self.held = self.tokens = self.at = 0
        self.docs: list[int] = []
        self.ends: list[int] = []
        self.offsets: list[int] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.open += [ids.astype("<u4"), np.array([self.end_id], "<u4")]
        self.held += len(ids) + 1
        self.tokens += len(ids) + 1
        self.docs.append(doc_id)
        self.ends.append(self.tokens)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            raw = pack(ids[k : min(k + self.block, whole)], self.width)
            self.offsets.append(self.at)
            self.stream.write(raw)
            self.at += len(raw)
        self.open, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for x in (self.docs, self.ends, self.offsets):
            self.stream.write(np.array(x, "<i8").tobytes())
        self.stream.write(np.array([len(self.docs), self.tokens, len(self.offsets), self.block, self.width, self.end_id], "<i8").tobytes() + MAGIC)
        self.stream.close()


class Reader:
    """Random access to a file of packed ids."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(_TRAILER, size - _TRAILER)
        if tail[48:] != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        docs, self.tokens, blocks, self.block, self.width, self.end_id = np.frombuffer(tail, "<i8", 6).tolist()
        foot = 8 * (2 * docs + blocks)
        self.data_end = size - _TRAILER - foot
        raw = np.frombuffer(self.file.read_at(foot, self.data_end), "<i8")
        self.docs, self.ends, self.offsets = raw[:docs], raw[docs : 2 * docs], raw[2 * docs :]

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), from their blocks alone."""
        out = []
        for b in range(start // self.block, -(-end // self.block)):
            lo = int(self.offsets[b])
            hi = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.data_end
            ids = unpack(self.file.read_at(hi - lo, lo), self.width, min(self.block, self.tokens - b * self.block))
            out.append(ids[max(0, start - b * self.block) : end - b * self.block])
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file, with the end id."""
        return self.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


MANIFEST = "path string, first_id long, first_hash long, n_docs long, n_tokens long"


def _write(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, first, task = encoder(path), None, None, TaskContext.get()
        fs, at = filesystem(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                if out is None:
                    out = Writer(fs.open_output_stream(f"{at}/{name}"), enc.size, end_id)
                    first = (part.column("doc_id")[0].as_py(), part.column("text_hash")[0].as_py())
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    out.add(NO_ID if doc is None else doc, ids)
        if out is not None:
            out.close()
            row = {"path": f"{folder}/{name}", "first_id": first[0], "first_hash": first[1], "n_docs": len(out.docs), "n_tokens": out.tokens}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("first_hash", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write(documents: DataFrame, vocabulary_path: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents in order of their ids; the manifest has a row per file.

    Manifest rows (as many as tasks) carry ``start``, the ids of all files before.
    """
    spark = tune(documents.sparkSession)
    folder = folder or scratch(spark, "tokens")
    fs, path = filesystem(folder)
    fs.create_dir(path)
    ordered = in_order(ids_and_texts(documents)).withColumn("text_hash", F.xxhash64("text"))
    # The job runs here; what comes back is one row a file.
    files = sorted(ordered.mapInArrow(_write(vocabulary_path, folder, end_id), MANIFEST).collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_hash or 0))
    start, rows = 0, []
    for k, r in enumerate(files):
        rows.append((k, r.path, start, r.n_docs, r.n_tokens))
        start += r.n_tokens
    return spark.createDataFrame(rows, "file int, path string, start long, n_docs long, n_tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, lo = Reader(row["path"]), 0
            while lo < len(file.docs):
                base = int(file.ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(file.ends, base + _STEP, "right")))
                ends = file.ends[lo:hi]
                starts = np.concatenate([[base], ends[:-1]])
                if ends[-1] - base <= _STEP:
                    ids = file.range(base, int(ends[-1]))
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip((starts - base).tolist(), (ends - base).tolist())]
                else:  # one long document, a step at a time
                    crc = [0]
                    for a in range(base, int(ends[-1]), _STEP):
                        crc = [zlib.crc32(file.range(a, min(a + _STEP, int(ends[-1]))), crc[0])]
                yield pa.record_batch([pa.array(file.docs[lo:hi], mask=file.docs[lo:hi] == NO_ID), pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                lo = hi


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, and the crc32 of its ids."""
    n = max(1, manifest.count())
    return manifest.repartitionById(n, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
