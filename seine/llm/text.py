"""Vectorised words of UTF-8 text: Arrow strings to numpy word spans and hashes.

All word rules here are sets of bytes, so a batch of texts is split with table
lookups over its bytes; every byte of a non-ASCII character is of one class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: ``[^\x20\x09-\x0D]``
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for i, base in enumerate((_P, _PINV)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, of one row at least."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(at, at[row] + most, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


#: Bytes that a row takes in Python, whatever its text.
ROW = 128


def gathered(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined as far as they have at most ``most`` bytes of text together, a row counting as ``ROW`` more."""
    held, size = [], 0
    for batch in batches:
        more = batch.column(column).nbytes + ROW * batch.num_rows
        if held and size + more > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


@dataclass
class Words:
    """Words of a batch: byte spans, the row of each, 64-bit hashes, rows' ranges."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word; one more than rows
    total: np.ndarray  # prefix sums from which any byte range is hashed

    def part_hash(self, size: int, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than ``size`` bytes, and the hash of their first (or last) so many."""
        at = np.flatnonzero(self.end - self.start > size)
        lo = self.end[at] - size if last else self.start[at]
        _, inverse = _power(len(self.total))
        return at, mix((self.total[lo + size] - self.total[lo]) * inverse[lo] + np.uint64(size * 2 + last << 32))


def words(column: pa.Array, keep: np.ndarray) -> Words:
    """Split every text into maximal runs of the bytes in ``keep``, A-Z lower-cased."""
    raw, at = utf8(column)
    data = LOWER[raw]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = keep[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    cut = edges[inside[edges] & inside[edges + 1]]
    begins[cut] = True
    ends[cut - 1] = True
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, start, end, row, hashed, first, total)


def hash_word(word: str | bytes) -> int:
    """The hash that ``words`` gives this word (it has to be lower-cased)."""
    raw = word.encode() if isinstance(word, str) else word
    got = words(pa.array([raw.decode()]), np.ones(256, bool))
    return int(got.hash[0])


def char_index(data: np.ndarray) -> np.ndarray:
    """Code points before each byte offset (one more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
