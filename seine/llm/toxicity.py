"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of other texts, whose
labels are not looked at, is the unlabelled mixture. Linear classifiers over
the presence of hashed words are trained in numpy on the non-negative risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P))

with logistic losses, a class prior taken from the labelled rows, and several
bootstrap members whose probabilities are averaged. Features are words and
their beginnings and ends (inflected and compound words share these), hashed:
the buckets whose document frequencies differ most between the two samples.

The samples are bounded (``POSITIVES``, ``UNLABELLED``): distinct rows (id and
text) of least hash. Their word counts are added up on the executors; to the
driver come the ``FEATURES`` chosen buckets and one bit of each for every
sampled row, whatever the length of its text. Everything else covers whole
texts of all rows.

Defined cases: a text without a word (null and empty ones too) gets the class
prior; without any positive (or any text) every score is 0; null texts are not
learned from, empty ones are rows without words; repeated rows are scored alike
and learned from once; labels of unknown documents and labels that are null
count for nothing but the class prior, where they are not null; an empty table
gives no rows. ``score`` replaces a column ``toxicity``, and keeps all others,
as ``clean`` keeps all. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.llm.session import Tables, ids_and_texts, tune
from seine.llm.text import ALNUM, Words, pieces, words

POSITIVES, UNLABELLED = 2000, 5000
FEATURES = 1024
#: Bytes of the beginnings and ends of words.
AFFIXES = (3, 4, 5, 6, 7, 8)
MEMBERS = 3
BITS = 20
FOLDS, HELD_OUT = 5, 0
_PIECE = 1 << 20


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and affix of a batch."""
    row, bucket = [w.row], [w.hash]
    for size in AFFIXES:
        for last in (False, True):
            at, h = w.part_hash(size, last)
            row.append(w.row[at])
            bucket.append(h)
    return np.concatenate(row), (np.concatenate(bucket) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    buckets: np.ndarray  # sorted; the feature of each is its index
    weight: np.ndarray  # members x (features + 1); the last is the bias
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Mean probability over the members for every text."""
        n = len(column)
        if not len(self.weight):
            return np.zeros(n)
        w = words(column, ALNUM)
        row, bucket = features(w)
        table = np.full(1 << BITS, -1, np.int32)
        table[self.buckets] = np.arange(len(self.buckets))
        feature = table[bucket]
        known = feature >= 0
        pair = np.unique(row[known] * len(self.buckets) + feature[known])
        row, feature = np.divmod(pair, max(1, len(self.buckets)))
        total = [m[-1] + np.bincount(row, weights=m[feature], minlength=n) for m in self.weight]
        mean = np.mean([1 / (1 + np.exp(-np.clip(t, -30, 30))) for t in total], 0)
        return np.where(np.diff(w.first) > 0, mean, min(self.prior, 0.49))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights (with the bias last) that minimise the non-negative risk, by Adam."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        as_negative = su @ u / len(u) - prior * (sp @ p) / len(p)  # gradient of R-(U) - prior R-(P)
        # Where the estimate of the negatives' risk falls below zero, it is driven up again alone.
        g = -prior * ((1 - sp) @ p) / len(p) + as_negative if negative >= 0 else -as_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(p: np.ndarray, u: np.ndarray, buckets: np.ndarray, prior: float, members: int = MEMBERS) -> Model:
    """A model from the presence (0 or 1) of sorted buckets in positive and in unlabelled texts."""
    if not len(p) or not len(u):
        return Model(np.zeros(0, np.int64), np.zeros((0, 1)), 0.0)
    prior = min(max(prior, 1e-3), 0.9)
    p, u = p.astype(np.float32), u.astype(np.float32)
    rng = np.random.default_rng(11)
    weight = [nnpu(p[rng.integers(0, len(p), len(p))], u[rng.integers(0, len(u), len(u))], prior) for _ in range(members)]
    return Model(buckets, np.array(weight, np.float64), prior)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", _PIECE):
            w = words(part.column("text"), ALNUM)
            row, b = features(w)
            pair = np.unique(row.astype(np.int64) << BITS | b)
            at = np.searchsorted(pair, np.arange(part.num_rows + 1) << BITS)
            b = (pair & (1 << BITS) - 1).astype(np.int32)
            rows = [b[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.record_batch([part.column("positive"), part.column("doc_id"), part.column("text_hash"), pa.array(rows, pa.binary())], names=["positive", "doc_id", "text_hash", "buckets"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, p, u): a task's positive and unlabelled texts that have a bucket (those of a text are distinct)."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for positive, b in zip(batch.column("positive").to_pylist(), batch.column("buckets")):
            counts[0 if positive else 1, np.frombuffer(b.as_buffer(), np.int32)] += 1
    some = np.flatnonzero(counts.any(0))
    yield pa.record_batch([pa.array(some, pa.int64()), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "p", "u"])


def _presence(buckets: np.ndarray):
    """(positive, bits): which of the sorted buckets each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.isin(buckets, np.frombuffer(b.as_buffer(), np.int32))).tobytes() for b in batch.column("buckets")]
            yield pa.record_batch([batch.column("positive"), pa.array(bits, pa.binary())], names=["positive", "bits"])

    return run


def _chosen(sample: DataFrame, n_p: int, n_u: int, most: int) -> np.ndarray:
    """The buckets whose document frequencies in the two samples differ most."""
    counts = sample.mapInArrow(_tally, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = F.abs((F.col("p") + 0.5) / (n_p + 1) - (F.col("u") + 0.5) / (n_u + 1)) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    return np.sort(np.array([r.bucket for r in counts.orderBy(z.desc(), "bucket").limit(most).collect()], np.int64))


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, folds: int = FOLDS, held_out: int = HELD_OUT, most: int = FEATURES) -> Model:
    """Fit on rows outside the held-out fold; both samples are bounded by their parameters."""
    tables = Tables(tune(documents.sparkSession))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(fold("doc_id", folds) != held_out)
    docs = ids_and_texts(documents).where(fold("doc_id", folds) != held_out).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    least = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    plus = known.where("toxic = 1").select("doc_id").distinct().orderBy(*least[:2]).limit(positives)
    keys = docs.select("doc_id", "text_hash")
    plus = keys.join(F.broadcast(plus), "doc_id").distinct().orderBy(*least).limit(positives).withColumn("positive", F.lit(True))
    rest = keys.distinct().orderBy(*least).limit(unlabelled).withColumn("positive", F.lit(False))
    # Both samples are bounded, so their keys are broadcast to the scan of the texts.
    rows = docs.join(F.broadcast(plus.union(rest)), ["doc_id", "text_hash"]).select("positive", "doc_id", "text_hash", "text")
    rows = rows.mapInArrow(_buckets, "positive boolean, doc_id long, text_hash long, buckets binary").dropDuplicates(["positive", "doc_id", "text_hash"])
    sample = tables.write(rows, "sample")
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    bits, buckets = {True: [], False: []}, np.zeros(0, np.int64)
    if len(sizes) == 2:
        buckets = _chosen(sample, sizes[True], sizes[False], most)
        order = ["positive", "doc_id", "text_hash"]
        for r in sample.orderBy(*order).mapInArrow(_presence(buckets), "positive boolean, bits binary").collect():
            bits[r.positive].append(r.bits)
    tables.drop(sample)
    p, u = (np.unpackbits(np.frombuffer(b"".join(bits[side]), np.uint8).reshape(len(bits[side]), -(-len(buckets) // 8)), axis=1, count=len(buckets)) for side in (True, False))
    return fit(p, u, buckets, (toxic or 0) / max(1, total))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents, and ``toxicity`` (0 to 1; a column of that name is replaced)."""
    tune(documents.sparkSession)
    documents = documents.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column("text")))], names=[*part.schema.names, "toxicity"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{fields}, toxicity double")


def clean(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold; all columns stay."""
    tune(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                yield part.filter(pa.array(model.score(part.column("text")) < threshold))

    return documents.mapInArrow(run, documents.schema)
