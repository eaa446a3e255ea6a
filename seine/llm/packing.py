"""Order-preserving packing by dynamic programming over cut positions.

Tokens of documents in order of their ids form one stream, cut into windows of
at most ``WINDOW`` tokens. Cuts are allowed at ends of documents (free) and of
sentences (``SENTENCE``), and, where a stretch has neither for a whole window,
at fixed steps (``HARD``). A window is padded to ``WINDOW`` unless its length
is a power of two. The dynamic programme finds, for each block of the stream,
the cuts of least padding plus penalties:

    best(j) = penalty(j) + min over i of best(i) + padding(b[j] - b[i])

For padded windows the minimum of ``best(i) + b[i]`` over the reach is kept in
a monotone queue (constant time a cut); windows of a power of two add at most
twelve transitions.

A block is ``BLOCK`` tokens of whole documents, so at most one window a block is
short of others. A longer document is a block of its own: its tokens and cuts
are held by its task, some hundred bytes a token at its end.

Defined cases: a null or empty text is its end id alone; repeated ids are
packed row by row, in order of their texts' hashes; no documents, no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seine.llm.session import ids_and_texts, in_order, tune
from seine.llm.text import gathered, pieces
from seine.llm.tokens import Encoder, encoder

WINDOW = 2048
SENTENCE = 2
HARD = 64
BLOCK = 1 << 18
#: Bytes of text encoded at once: each round has a share of cost that doesn't depend on its size.
READ = 4 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def cuts(b: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``b`` (ascending positions from 0; gaps of at most ``window``) of the best cuts."""
    m = len(b)
    index = np.full(int(b[-1]) + 1, -1, np.int32)
    index[b] = np.arange(m)
    froms, tos = [], []
    for k in range(window.bit_length()):
        if 1 << k > window:
            break
        j = np.flatnonzero(b >= 1 << k)
        i = index[b[j] - (1 << k)]
        froms.append(i[i >= 0])
        tos.append(j[i >= 0])
    to, source = np.concatenate(tos), np.concatenate(froms)
    order = np.argsort(to, kind="stable")
    to_l, from_l = [*to[order].tolist(), m], source[order].tolist()
    at, pen = b.tolist(), penalty.tolist()
    best, back = [0] * m, [0] * m
    queue, keys, head = [0] * m, [0] * m, 0
    tail = 1  # queue[head:tail], keys ascending
    keys[0] = at[0]
    e = 0
    for j in range(1, m):
        here = at[j]
        low = here - window
        while at[queue[head]] < low:
            head += 1
        value, source_ = keys[head] + window - here, queue[head]
        while to_l[e] == j:
            i = from_l[e]
            if best[i] < value:
                value, source_ = best[i], i
            e += 1
        value += pen[j]
        best[j], back[j] = value, source_
        key = value + here
        while tail > head and keys[tail - 1] >= key:
            tail -= 1
        queue[tail], keys[tail] = j, key
        tail += 1
    out, j = [m - 1], m - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def sentence_ends(enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: does it end a sentence; does it begin with white space."""
    n = enc.size
    ends, space = np.zeros(n, bool), np.zeros(n, bool)
    for token, i in enc.library.get_vocab(with_added_tokens=True).items():
        ends[i] = token.rstrip("\"')]")[-1:] in (".", "!", "?") or token[-1:] == "Ċ"
        space[i] = token[:1] in ("Ġ", "Ċ")
    return ends, space


def positions(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, space: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a block and their penalties."""
    inner = np.flatnonzero(ends[ids[:-1]] & space[ids[1:]]) + 1
    b = np.union1d(np.concatenate([[0], inner]), doc_ends)
    gap = np.diff(b)
    wide = np.flatnonzero(gap > window)
    hard = [np.arange(b[k] + window // 4, b[k + 1], window // 4) for k in wide]
    kind = np.full(int(doc_ends[-1]) + 1, SENTENCE, np.int64)
    kind[doc_ends] = 0
    if hard:
        extra = np.concatenate(hard)
        kind[extra] = HARD
        b = np.union1d(b, extra)
    return b, kind[b]


def _pack(path: str, window: int, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        ends, space = sentence_ends(enc)
        sequence = TaskContext.get().partitionId() << 40
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], enc.dtype)

        def flush() -> pa.RecordBatch:
            nonlocal sequence, docs, held, size
            ids = np.concatenate(held)
            doc_ends = np.cumsum([len(x) for x in held])
            b, penalty = positions(ids, doc_ends, ends, space, window)
            windows = b[cuts(b, penalty, window)]
            edge = np.union1d(windows, doc_ends)
            edge = np.concatenate([[0], edge[edge > 0]])
            lo, hi = edge[:-1], edge[1:]
            doc = np.searchsorted(doc_ends, lo, "right")
            win = np.searchsorted(windows, lo, "right") - 1
            first = np.concatenate([[0], doc_ends[:-1]])
            raw, four = ids.astype("<u4").tobytes(), 4
            out = pa.record_batch(
                [pa.array([docs[d] for d in doc], pa.int64()), pa.array(lo - first[doc]), pa.array(hi - lo), pa.array((doc_ends - first)[doc]), pa.array(sequence + win), pa.array(lo - windows[win]), pa.array([raw[four * x : four * y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())],
                schema=_SCHEMA,
            )
            sequence += len(windows) - 1
            docs, held, size = [], [], 0
            return out

        for batch in gathered(batches, "text", READ):
            for part in pieces(batch, "text", READ):
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    if size and size + len(ids) >= block:
                        yield flush()
                    docs.append(doc)
                    held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
        if size:
            yield flush()

    return run


def pack(documents: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = 1, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents in windows: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bits)."""
    tune(documents.sparkSession)
    return in_order(ids_and_texts(documents)).mapInArrow(_pack(vocabulary_path, window, end_id, block), PIECES)
