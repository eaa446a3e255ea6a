"""Language identification by a byte convolutional network, in numpy.

Texts are cut into windows of ``WINDOW`` bytes that cover them whole (the last
padded with spaces). A window's bytes are embedded, convolved with filters of
several widths, max-pooled over the window, and classified by a softmax; a
text's score of a language is the mean over its windows, weighted by bytes.

Training takes at most ``DOCUMENTS`` rows with a language: of each language an
equal quota (all its rows, if it has fewer), those of least hash of their ids,
and up to ``PER_DOCUMENT`` windows of each. So few rows hold at most as many
languages, of which the most frequent are learned; that is the one bound on
them. lang, source and doc_id are no inputs of a prediction.

Defined cases: a null text, or one without a letter (``str.isalpha``; digits of
any kind are none), is ``und`` with score 0, as is every text when no row has a
language; repeated rows agree (a training row that is repeated may be drawn as
often); very long texts are taken window by window; an empty table gives no
rows; other columns, ``lang_pred`` and ``score`` too, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.llm.session import tune
from seine.llm.text import pieces, utf8

WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4), 16, 8
DOCUMENTS, PER_DOCUMENT = 2400, 2
EPOCHS, BATCH = 8, 64
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_STEP = 256


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text of each, and its share of that text."""
    size = np.diff(at)
    many = np.maximum(1, -(-size // WINDOW))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.full((int(first[-1]), WINDOW), 32, np.uint8)
    flat = out.reshape(-1)
    for k in np.flatnonzero(size):
        flat[first[k] * WINDOW : first[k] * WINDOW + size[k]] = raw[at[k] : at[k + 1]]
    owner = np.repeat(np.arange(len(size)), many)
    held = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return out, owner, np.maximum(held, 1) / np.maximum(size, 1)[owner]


@dataclass
class Network:
    languages: list[str]
    parts: list[np.ndarray]  # embedding, (filters, bias) by width, output, bias

    @classmethod
    def new(cls, languages: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        parts = [(rng.standard_normal((256, DIM)) * 0.5).astype(np.float32)]
        for w in WIDTHS:
            parts += [f(w * DIM, FILTERS), np.zeros(FILTERS, np.float32)]
        return cls(languages, [*parts, f(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32)])

    def _convolve(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        e = self.parts[0][x]
        for k, w in enumerate(WIDTHS):
            n = x.shape[1] - w + 1
            u = np.concatenate([e[:, o : o + n] for o in range(w)], 2)
            yield u, u.reshape(-1, w * DIM) @ self.parts[1 + 2 * k]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(x), _STEP):
            part = x[k : k + _STEP]
            pooled = [z.reshape(len(part), -1, FILTERS).max(1) + self.parts[2 + 2 * i] for i, (_, z) in enumerate(self._convolve(part))]
            logit = np.maximum(np.concatenate(pooled, 1), 0) @ self.parts[-2] + self.parts[-1]
            logit = np.exp(logit - logit.max(1, keepdims=True))
            out.append(logit / logit.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of a batch and its gradients."""
        n, held, pooled = len(x), [], []
        for i, (u, z) in enumerate(self._convolve(x)):
            z = z.reshape(n, -1, FILTERS)
            at = z.argmax(1)
            held.append((u, at))
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.parts[2 + 2 * i])
        p = np.concatenate(pooled, 1)
        h = np.maximum(p, 0)
        logit = h @ self.parts[-2] + self.parts[-1]
        logit -= logit.max(1, keepdims=True)
        q = np.exp(logit)
        q /= q.sum(1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), y] + 1e-9).mean())
        q[np.arange(n), y] -= 1
        q /= n
        back = (q @ self.parts[-2].T) * (p > 0)
        embed, conv = np.zeros_like(self.parts[0]), []
        for i, (w, (u, at)) in enumerate(zip(WIDTHS, held)):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            seen = u[np.arange(n)[:, None], at]  # batch, filter, width * dim
            conv += [np.einsum("bfe,bf->ef", seen, d), d.sum(0)]
            spread = d[:, :, None] * self.parts[1 + 2 * i].T[None]
            place = at[:, :, None] + np.arange(w)
            np.add.at(embed, x[np.arange(n)[:, None, None], place], spread.reshape(n, FILTERS, w, DIM))
        return loss, [embed, *conv, h.T @ q, q.sum(0)]


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.004) -> Network:
    """Adam over shuffled batches."""
    net, rng, t = Network.new(languages), np.random.default_rng(9), 0
    m, v = ([np.zeros_like(p) for p in net.parts] for _ in range(2))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            t += 1
            _, g = net.gradients(x[order[k : k + BATCH]], y[order[k : k + BATCH]])
            for i, gi in enumerate(g):
                m[i] = 0.9 * m[i] + 0.1 * gi
                v[i] = 0.999 * v[i] + 0.001 * gi * gi
                net.parts[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``PER_DOCUMENT`` windows of every text, spread over the whole of it."""
    for batch in batches:
        for part in pieces(batch, "text", 2 << 20):
            w, owner, _ = windows(*utf8(part.column("text")))
            many = np.bincount(owner, minlength=part.num_rows)
            first = np.cumsum(many) - many
            at = np.unique(np.concatenate([first + many * k // PER_DOCUMENT for k in range(PER_DOCUMENT)]))
            yield pa.record_batch([part.column("lang").take(pa.array(owner[at])), pa.array([x.tobytes() for x in w[at]], pa.binary())], names=["lang", "window"])


def train(documents: DataFrame, most: int = DOCUMENTS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Network | None:
    """A network from at most ``most`` rows outside the held-out fold; None where no row has a language."""
    tune(documents.sparkSession)
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where("lang is not null and text is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held_out)
    counts = dict(map(tuple, d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()))
    if not counts:
        return None
    quota = most // len(counts)
    # A thinned draw first (at most a few quotas a language), of which each language keeps its rows of least hash.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * quota + 32) / n))])
    drawn = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = drawn.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= quota).select("lang", "text").mapInArrow(_samples, "lang string, window binary").collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    x = np.frombuffer(b"".join(r.window for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([languages.index(r.lang) for r in rows]), languages)


def predict(column: pa.Array, net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of every whole text."""
    texts = column.to_pylist()
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
    if some:
        raw, at = utf8(column.take(pa.array(some)))
        w, owner, share = windows(raw, at)
        total = np.zeros((len(some), len(net.languages)))
        np.add.at(total, owner, net.probabilities(w) * share[:, None])
        best = total.argmax(1)
        for k, b, s in zip(some, best.tolist(), total[np.arange(len(some)), best]):
            lang[k], score[k] = net.languages[b], min(1.0, s)
    return lang, score


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    tune(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                lang, score = predict(part.column("text"), net)
                yield pa.record_batch([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
