"""Chroma audio fingerprints and their alignment.

A recording (16-bit PCM) becomes frames of twelve pitch-class energies. Filters
over the integral image of these frames, each quantised to two bits in Gray
code, give one packed 32-bit integer a frame. Two recordings are aligned by the
histogram of offsets at which their integers are equal, and judged by the share
of bits that differ over the overlap.

``search`` takes a stated set of query recordings against all. Recordings of
equal integers are one class, which its smallest id stands for, so copies are
not expanded into pairs. Runs of equal integers (silence, a held tone) are one
row each, and runs of equal values are joined (shuffled, and pre-aggregated to
votes per query, recording and offset), so no pair without a common value is
formed and two runs meet in as many rows as they have offsets, not frames
squared.

Defined cases: null audio, or less than a window of it, has no integers and
matches nothing; silence gives integers like any sound; repeated rows agree
(rows of equal ids are one recording, of the row with the most frames); a row
without an id aligns with nothing and has no class; no rows give no rows. Other
columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.llm.session import Tables, tune

RATE, FRAME, HOP = 4096, 512, 128
LOW, HIGH = 100.0, 1800.0
WIDTH = 16
MIN_VOTES = 6
#: (shape, first class, classes, frames): two halves in pitch, in time, four quarters, three bands.
FILTERS = (
    ("pitch", 0, 12, 8), ("pitch", 1, 4, 6), ("pitch", 4, 6, 10), ("pitch", 7, 4, 12), ("time", 0, 3, 8), ("time", 3, 3, 12), ("time", 6, 3, 16), ("time", 9, 3, 8),
    ("quarter", 0, 6, 8), ("quarter", 4, 6, 12), ("quarter", 6, 6, 16), ("quarter", 2, 8, 10), ("bands", 0, 9, 6), ("bands", 3, 9, 9), ("bands", 1, 6, 12), ("time", 0, 12, 16),
)
CUTS = (-0.08, 0.0, 0.08)
_GRAY = np.array([0, 1, 3, 2], np.uint32)
_WINDOW = np.hanning(FRAME).astype(np.float32)
_freq = np.fft.rfftfreq(FRAME, 1 / RATE)
_used = np.flatnonzero((_freq >= LOW) & (_freq <= HIGH))
_class = np.round(12 * np.log2(_freq[_used] / 440)).astype(int) % 12
#: Bins ordered by their pitch class, and where each class begins among them.
_BINS = _used[np.argsort(_class, kind="stable")]
_STARTS = np.searchsorted(np.sort(_class), np.arange(12))
#: Samples that are transformed at once.
_BLOCK = 1 << 19


def frames(pcm: np.ndarray) -> np.ndarray:
    """Normalised pitch-class energies, a row for every hop, of one recording or of several of a length."""
    if pcm.shape[-1] < FRAME:
        return np.zeros((*pcm.shape[:-1], 0, 12))
    view = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME, axis=-1)[..., ::HOP, :]
    tone = np.fft.rfft(view * _WINDOW)[..., _BINS]
    # Sums of a fixed order, so that equal recordings have equal energies however many are taken at once.
    chroma = np.add.reduceat((tone.real**2 + tone.imag**2).astype(np.float64), _STARTS, axis=-1)
    norm = np.sqrt((chroma**2).sum(-1, keepdims=True))
    return chroma / np.where(norm > 1e-9, norm, 1)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """Packed integers of one recording, or of each of several of a length."""
    c = frames(pcm)
    n = c.shape[-2] - WIDTH + 1
    if n <= 0:
        return np.zeros((*pcm.shape[:-1], 0), np.uint32)
    integral = np.zeros((13, *pcm.shape[:-1], c.shape[-2] + 1))
    integral[1:, ..., 1:] = np.moveaxis(np.cumsum(np.cumsum(c, -2), -1), -1, 0)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        by_time = integral[p1, ..., t1 : t1 + n] - integral[p1, ..., t0 : t0 + n] - integral[p0, ..., t1 : t1 + n] + integral[p0, ..., t0 : t0 + n]
        return by_time / ((t1 - t0) * (p1 - p0))

    out = np.zeros((*pcm.shape[:-1], n), np.uint32)
    for shape, first, classes, width in FILTERS:
        end, mid, half = first + classes, first + classes // 2, width // 2
        if shape == "pitch":
            value = area(0, width, mid, end) - area(0, width, first, mid)
        elif shape == "time":
            value = area(half, width, first, end) - area(0, half, first, end)
        elif shape == "quarter":
            value = area(0, half, first, mid) + area(half, width, mid, end) - area(0, half, mid, end) - area(half, width, first, mid)
        else:
            third = width // 3
            value = area(third, 2 * third, first, end) * 2 - area(0, third, first, end) - area(2 * third, width, first, end)
        out = (out << np.uint32(2)) | _GRAY[(value > CUTS[0]).view(np.int8) + (value > CUTS[1]).view(np.int8) + (value > CUTS[2]).view(np.int8)]
    return out


def fingerprint_all(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """``fingerprint`` of each, those of a length together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(recordings)
    alike: dict[int, list[int]] = {}
    for k, x in enumerate(recordings):
        alike.setdefault(len(x), []).append(k)
    for size, ks in alike.items():
        step = max(1, _BLOCK // max(1, size))
        for at in range(0, len(ks), step):
            part = ks[at : at + step]
            for k, prints in zip(part, fingerprint(np.stack([recordings[k] for k in part]))):
                out[k] = prints
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where ``a[i + offset]`` meets ``b[i]``."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 1.0
    return float(np.bitwise_count(a[lo + offset : hi + offset] ^ b[lo:hi]).sum()) / (32 * (hi - lo))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Best offset of ``b`` in ``a``, its votes, and the bit error there."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    many = hi - lo
    at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    offset, votes = np.unique(np.repeat(np.arange(len(a)), many) - order[at], return_counts=True)
    if not len(votes):
        return 0, 0, 1.0
    k = int(np.lexsort((offset, -votes))[0])
    return int(offset[k]), int(votes[k]), bit_error(a, b, int(offset[k]))


def sonify(vector: np.ndarray | list[float]) -> bytes:
    """A melody of the vector's values, a sixteenth of a second each (16-bit PCM).

    The tables hold no audio; this stands for a media column.
    """
    v = np.nan_to_num(np.asarray(vector, np.float64))
    pitch = 48 + np.floor(24 * (0.5 + np.arctan(6 * v) / np.pi)).clip(0, 23)
    step = np.repeat(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) / RATE, RATE // 16)
    return (12_000 * np.sin(np.cumsum(step))).astype("<i2").tobytes()


def _prints(decode: Callable[[Any], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heard = []
            for x in batch.column("audio"):
                raw = b"" if not x.is_valid else x.as_py() if decode is None else decode(x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x.as_py())
                heard.append(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"))
            found = fingerprint_all(heard)
            yield pa.record_batch([batch.column("id"), pa.array([f.view(np.int32) for f in found], pa.list_(pa.int32())), pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64())], names=["id", "prints", "prints_crc32"])

    return run


def fingerprints(media: DataFrame, id_column: str, audio: Column, decode: Callable[[Any], bytes] | None = None) -> DataFrame:
    """Per recording: id, prints (packed integers), prints_crc32.

    ``decode`` makes 16-bit PCM of the column's values where they are read;
    without it they are that already.
    """
    tune(media.sparkSession)
    return media.select(F.col(id_column).cast("long").alias("id"), audio.alias("audio")).mapInArrow(_prints(decode), "id long, prints array<int>, prints_crc32 long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, query_id, n, value, at, size): runs of equal integers."""
    for batch in batches:
        prints = batch.column("prints")
        first = np.asarray(prints.offsets, np.int64)
        value = np.asarray(prints.values)[first[0] : first[-1]]
        first = first - first[0]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        new[first[:-1][np.diff(first) > 0]] = True
        start = np.flatnonzero(new)
        row = np.searchsorted(first, start, "right") - 1
        size = np.diff(np.append(start, len(value)))
        take = pa.array(row)
        yield pa.record_batch(
            [batch.column("class_id").take(take), batch.column("query_id").take(take), pa.array(np.diff(first)[row]), pa.array(value[start], pa.int32()), pa.array(start - first[row]), pa.array(size)],
            names=["class_id", "query_id", "n", "value", "at", "size"],
        )


PAIRS = "id long, query_id long, offset int, votes long, bit_error double"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c) for c in ("a", "b"))
        error = [bit_error(np.array(x, np.int32).view(np.uint32), np.array(y, np.int32).view(np.uint32), o) for x, y, o in zip(a.to_pylist(), b.to_pylist(), batch.column("offset").to_pylist())]
        yield pa.record_batch([batch.column("id"), batch.column("query_id"), batch.column("offset"), batch.column("votes"), pa.array(error, pa.float64())], names=["id", "query_id", "offset", "votes", "bit_error"])


def search(prints: DataFrame, is_query: Column, min_votes: int = MIN_VOTES) -> DataFrame:
    """Per recording: id, class_id, n_prints, prints_crc32, and, for each query that its class aligns with, query_id, offset, votes and bit_error.

    ``class_id`` is the smallest id of the recordings with the same integers;
    the pairs of a class are given with that id, once for each class of queries,
    under the smallest id of its queries (the largest, where the smallest is the
    recording itself). Rows without a pair have nulls there. The floor of votes is ``min_votes``, or all
    integers of the shorter of the two if it has fewer.
    """
    tables = Tables(prints.sparkSession)
    p = tables.write(prints, "prints")
    one = p.where("id is not null").groupBy("id").agg(F.max_by("prints", F.struct(F.size("prints"), "prints_crc32")).alias("prints"))
    one = one.select("id", F.when(F.size("prints") > 0, F.sha2(F.concat_ws(",", F.transform("prints", lambda x: x.cast("string"))).cast("binary"), 256)).alias("digest"), "prints")
    asked_id = F.when(is_query, F.col("id"))
    kinds = one.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"), F.min(asked_id).alias("query_id"), F.max(asked_id).alias("other_query"), F.first("prints").alias("prints"))
    kinds = tables.write(kinds, "kinds")
    runs = kinds.select("class_id", "query_id", "prints").mapInArrow(_runs, "class_id long, query_id long, n long, value int, at long, size long")
    asked = runs.where("query_id is not null").select("query_id", F.col("class_id").alias("query_class"), F.col("n").alias("query_n"), "value", F.col("at").alias("query_at"), F.col("size").alias("query_size"))
    posts = runs.select("class_id", "n", "value", "at", "size").join(asked, "value").where("class_id <> query_class")
    step = F.explode(F.sequence(1 - F.col("query_size"), F.col("size") - 1)).alias("step")
    met = posts.select("class_id", "query_id", F.least("n", "query_n", F.lit(min_votes)).alias("floor"), (F.col("at") - F.col("query_at")).alias("first"), "size", "query_size", step)
    votes = met.groupBy("class_id", "query_id", (F.col("first") + F.col("step")).cast("int").alias("offset"))
    # Frames of the two runs that meet at an offset.
    both = F.least("size", "query_size", F.col("step") + F.col("query_size"), F.col("size") - F.col("step"))
    votes = votes.agg(F.sum(both).cast("long").alias("votes"), F.max("floor").alias("floor")).where("votes >= floor")
    best = votes.groupBy("class_id", "query_id").agg(F.max(F.struct("votes", "offset")).alias("x")).select(F.col("class_id").alias("id"), "query_id", "x.offset", "x.votes")
    pairs = best.join(kinds.select(F.col("class_id").alias("id"), F.col("prints").alias("a")), "id").join(kinds.select("query_id", F.col("prints").alias("b")), "query_id")
    found = pairs.select("id", "query_id", "offset", "votes", "a", "b").mapInArrow(_judged, PAIRS)
    # A class that holds a query aligns with it whole; its smallest id may be that query itself.
    own = F.when(F.col("query_id") == F.col("class_id"), F.col("other_query")).otherwise(F.col("query_id"))
    own = kinds.select(F.col("class_id").alias("id"), own.alias("query_id"), F.lit(0).alias("offset"), F.size("prints").cast("long").alias("votes"), F.lit(0.0).alias("bit_error")).where("query_id <> id")
    member = one.join(kinds.select("digest", "class_id"), "digest").select("id", "class_id")
    rows = p.select("id", F.size("prints").cast("long").alias("n_prints"), "prints_crc32")
    return rows.join(member, "id", "left").join(found.union(own), "id", "left")
