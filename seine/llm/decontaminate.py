"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of documents of bounded bytes. Its words become symbols of the
phrases' alphabet; words outside it end a run, and runs shorter than the
shortest phrase hold none, so neither is indexed. Over the rest the shard gets
a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled
suffix positions. All phrases are searched backwards at once, word by word, and
their occurrences located and merged into removal spans.

Words are looked up by 64-bit hashes; every word that a phrase hits is spelled
out, and where two words share a hash the shard is searched again with symbols
given by spelling, so hashes decide nothing.

Defined cases: a null or empty text has no words and no hits; an item without
words has no phrase; equal phrases of several items count for each item;
phrases of an item without an id hit (and are removed) like any other, but the
item is in no list of items; repeated rows are each judged alone; an empty
benchmark hits nothing, an empty table gives no rows. Other columns of the
documents are kept out of the way by name (only ``doc_id`` and ``text`` are
read).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.session import filesystem, scratch, tune
from seine.llm.text import ALNUM, Words, char_index, pieces, utf8, words

#: Words of the items whose phrases are held (and sent to the executors) at a
#: time, some 80 bytes each as built; a larger benchmark is searched in as many
#: blocks as it takes. An item is never parted: a longer one is a block.
BLOCK_WORDS = 400_000
_ITEM_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
SHARD_BYTES = 8 << 20
SAMPLE = 8


class FMIndex:
    """FM-index of a symbol sequence in which 0 ends every run.

    Separators sort by position, so the order of suffixes is settled within
    runs. A row's suffix position is sampled at every ``SAMPLE``-th position and
    at every start of a run, so that no walk crosses a separator.
    """

    def __init__(self, seq: np.ndarray, alphabet: int) -> None:
        n = len(seq)
        self.n = n
        sa = _suffix_array(seq)
        bwt = seq[sa - 1]  # position 0 takes the last separator
        self.count = np.zeros(alphabet + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=alphabet + 1), out=self.count[1:])
        self.levels = max(1, int(alphabet).bit_length())
        self.zeros: list[np.ndarray] = []
        self.split: list[int] = []
        x = bwt
        for level in range(self.levels - 1, -1, -1):
            zero = ((x >> level) & 1) == 0
            rank = np.zeros(n + 1, np.int32)
            np.cumsum(zero, out=rank[1:])
            self.zeros.append(rank)
            self.split.append(int(rank[-1]))
            x = np.concatenate([x[zero], x[~zero]])
        symbols = np.arange(alphabet + 1)
        self.base = self._down(symbols, np.zeros(alphabet + 1, np.int64))
        self.sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            zero = self.zeros[k][at]
            at = np.where((symbol >> level) & 1, self.split[k] + at - zero, zero)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each row."""
        return self._down(symbol, at) - self.base[symbol]

    def access(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of the transform at each row, and its rank there."""
        symbol = np.zeros(len(row), np.int64)
        for k in range(self.levels):
            zero = self.zeros[k][row]
            one = self.zeros[k][row + 1] == zero
            symbol = (symbol << 1) | one
            row = np.where(one, self.split[k] + row - zero, zero)
        return symbol, row - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, padded): those that occur, and their row ranges."""
        live = np.arange(len(patterns))
        lo = np.zeros(len(live), np.int64)
        hi = np.full(len(live), self.n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            symbol = patterns[live, lengths[live] - 1 - step]
            lo = self.count[symbol] + self.rank(symbol, lo)
            hi = self.count[symbol] + self.rank(symbol, hi)
            step += 1
            some = lo < hi
            ended = some & (lengths[live] == step)
            done.append((live[ended], lo[ended], hi[ended]))
            going = some & ~ended
            live, lo, hi = live[going], lo[going], hi[going]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (live, lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at these rows."""
        out = np.zeros(len(row), np.int64)
        open_, steps = np.arange(len(row)), 0
        row = row.astype(np.int64)
        while len(open_):
            found = self.sampled[row]
            out[open_[found]] = self.samples[self.sample_rank[row[found]]] + steps
            open_, row = open_[~found], row[~found]
            if len(open_):
                symbol, rank = self.access(row)
                row = self.count[symbol] + rank
            steps += 1
        return out


def _suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; 0 symbols are distinct, in order of position."""
    n = len(seq)
    ends = seq == 0
    rank = np.where(ends, np.cumsum(ends) - 1, seq.astype(np.int64) + int(ends.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_ = rank[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_[1:] != sorted_[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = rank[step:] + 1
        # Only rows that still tie are sorted again.
        tied = np.zeros(n, bool)
        same = new[1:] == new[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        rows = order[at]
        again = np.argsort(rank[rows] * (n + 1) + nxt[rows], kind="stable")
        order[at] = rows[again]
        rank = rank * (n + 1) + nxt
        # Rows that do not tie keep their order: the first key decides.
        step *= 2


@dataclass
class Phrases:
    """Distinct phrases as symbol rows, with the items that hold each."""

    vocabulary: np.ndarray  # sorted hashes; symbol k + 1 is the k-th
    spelled: list[bytes]  # the words, by symbol - 1
    patterns: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: np.ndarray

    @property
    def ambiguous(self) -> bool:
        """Whether two of the words share a hash."""
        return bool((self.vocabulary[1:] == self.vocabulary[:-1]).any())

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], window: int = 10) -> Phrases:
        w = words(pa.array([t for _, t in items], pa.string()), ALNUM)
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(w.data[a:b].tobytes(), len(seen)) for a, b in zip(w.start.tolist(), w.end.tolist())], np.int64)
        hashes = np.zeros(len(seen), np.uint64)
        hashes[number] = w.hash
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(seen), np.int32)
        place[order] = np.arange(1, len(seen) + 1)
        spelled = list(seen)
        symbol = np.concatenate([place[number], np.zeros(window, np.int32)]).astype(np.int32)
        # A phrase begins at every word with a whole window after it in its item, or at the first of a short item.
        left = w.first[1:][w.row] - np.arange(len(w.row))
        start = np.flatnonzero((left >= window) | (np.arange(len(w.row)) == w.first[:-1][w.row]))
        length = np.minimum(left[start], window)
        rows = symbol[start[:, None] + np.arange(window)] * (np.arange(window) < length[:, None])
        patterns, at, which = np.unique(rows.astype(np.int32), axis=0, return_index=True, return_inverse=True)
        named = np.array([i is not None for i, _ in items], bool)
        ids = np.array([i or 0 for i, _ in items], np.int64)
        row = w.row[start]
        pair = np.unique(np.stack([which.reshape(-1), ids[row]], 1)[named[row]], axis=0) if len(start) else np.zeros((0, 2), np.int64)
        item_at = np.searchsorted(pair[:, 0], np.arange(len(patterns) + 1))
        return cls(hashes[order], [spelled[k] for k in order], patterns, length[at].astype(np.int64), item_at, pair[:, 1])

    def symbols(self, w: Words, by_spelling: bool) -> np.ndarray:
        """The symbol of every word of a shard, 0 for those that no phrase has."""
        where = np.searchsorted(self.vocabulary, w.hash)
        where[where == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[where] == w.hash, where + 1, 0)
        if by_spelling:
            number = {s: k + 1 for k, s in enumerate(self.spelled)}
            for k in np.flatnonzero(symbol):
                symbol[k] = number.get(w.data[w.start[k] : w.end[k]].tobytes(), 0)
        return symbol


def _runs(symbol: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of the runs of known words, each ended by 0, and the word of each place."""
    at = np.flatnonzero(symbol)
    if not len(at):
        return np.zeros(0, np.int64), at
    breaks = np.ones(len(at) + 1, bool)
    breaks[1:-1] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    edge = np.flatnonzero(breaks)
    size = np.diff(edge)
    run = np.repeat(np.arange(len(size)), size)
    keep = size >= least
    at, run = at[keep[run]], run[keep[run]]
    if not len(at):
        return np.zeros(0, np.int64), at
    number = (np.cumsum(keep) - 1)[run]
    place = np.arange(len(at)) + number
    seq = np.zeros(len(at) + int(keep.sum()), np.int64)
    seq[place] = symbol[at]
    word = np.full(len(seq), -1, np.int64)
    word[place] = at
    return seq, word


def _blocks(held: list[Phrases | str]) -> Iterator[Phrases]:
    """Blocks of phrases, those in the shared folder read one at a time."""
    for x in held:
        if isinstance(x, str):
            fs, path = filesystem(x)
            with fs.open_input_stream(path) as f:
                x = pickle.loads(f.read())
        yield x


def search_shard(column: pa.Array, held: list[Phrases | str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a shard, which of them are hit, and distinct (row, item id) pairs."""
    w = words(column, ALNUM)
    hit = np.zeros(len(w.start), bool)
    pairs = [np.zeros((0, 2), np.int64)]
    for phrases in _blocks(held) if len(w.start) else ():
        pairs.append(_search_block(w, phrases, hit))
    return w, hit, np.unique(np.concatenate(pairs), axis=0)


def _search_block(w: Words, phrases: Phrases, hit: np.ndarray) -> np.ndarray:
    if not len(phrases.lengths):
        return np.zeros((0, 2), np.int64)
    found = None if phrases.ambiguous else _occurrences(w, phrases, by_spelling=False)
    if found is None:
        found = _occurrences(w, phrases, by_spelling=True)
    new, pair = found
    hit |= new
    held = phrases.item_at[pair[:, 1] + 1] - phrases.item_at[pair[:, 1]]
    offset = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
    item = phrases.items[offset + np.repeat(phrases.item_at[pair[:, 1]], held)]
    return np.stack([np.repeat(pair[:, 0], held), item], 1)


def _occurrences(w: Words, phrases: Phrases, by_spelling: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Hit words and distinct (row, phrase) pairs; None if a hit word has another's hash."""
    hit, none = np.zeros(len(w.start), bool), np.zeros((0, 2), np.int64)
    symbol = phrases.symbols(w, by_spelling)
    seq, word = _runs(symbol, w.row, int(phrases.lengths.min()))
    if not len(seq):
        return hit, none
    index = FMIndex(seq, len(phrases.vocabulary))
    found, lo, hi = index.search(phrases.patterns, phrases.lengths)
    if not len(found):
        return hit, none
    many = hi - lo
    which = np.repeat(found, many)
    first = np.cumsum(many) - many
    rows = np.arange(int(many.sum())) - np.repeat(first, many) + np.repeat(lo, many)
    start = word[index.locate(rows)]
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + phrases.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    if not by_spelling and any(w.data[w.start[k] : w.end[k]].tobytes() != phrases.spelled[symbol[k] - 1] for k in np.flatnonzero(hit)):
        return None
    return hit, np.unique(np.stack([w.row[start], which], 1), axis=0)


def _spans(w, hit: np.ndarray, row: int) -> list[tuple[int, int]]:
    """Byte spans of a row's runs of hit words, merged."""
    a, b = w.first[row], w.first[row + 1]
    mark = np.zeros(b - a + 2, np.int8)
    mark[1:-1] = hit[a:b]
    step = np.diff(mark)
    return [(int(w.start[a + i]), int(w.end[a + j - 1])) for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]


REPORT = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def _report(held: list[Phrases | str], shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", shard_bytes):
                w, hit, pairs = search_shard(part.column("text"), held)
                n = part.num_rows
                found: list[list[int]] = [[] for _ in range(n)]
                for d, i in pairs.tolist():
                    found[d].append(i)
                spans: list[list[dict]] = [[] for _ in range(n)]
                hits = np.bincount(w.row[hit], minlength=n)
                if hits.any():
                    chars = char_index(w.data)
                    _, at = utf8(part.column("text"))
                    for r in np.flatnonzero(hits):
                        zero = chars[at[r]]
                        spans[r] = [{"start": int(chars[a] - zero), "end": int(chars[b] - zero)} for a, b in _spans(w, hit, r)]
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(w.first), pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def _clean(held: list[Phrases | str], shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", shard_bytes):
                column = part.column("text")
                texts: list | None = None
                rows = np.arange(part.num_rows)
                while len(rows):  # removal can join words into a new occurrence
                    w, hit, _ = search_shard(column, held)
                    raw, at = utf8(column)
                    bad = np.unique(w.row[hit])
                    if not len(bad):
                        break
                    texts = texts if texts is not None else part.column("text").to_pylist()
                    kept = []
                    for r in bad:
                        out, last = [], int(at[r])
                        for a, b in _spans(w, hit, r):
                            out.append(raw[last:a].tobytes())
                            last = b
                        out.append(raw[last : at[r + 1]].tobytes())
                        kept.append(b"".join(out).decode())
                    rows = rows[bad]
                    for r, t in zip(rows, kept):
                        texts[r] = t
                    column = pa.array(kept, pa.string())
                if texts is None:
                    yield part
                else:
                    yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type))

    return run


def phrase_blocks(benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> list[Phrases | str]:
    """Phrases of the benchmark in blocks of bounded size.

    The words of the items are counted first. One block goes to the tasks with
    the plan; more are collected one at a time and kept in the shared folder,
    from which a task reads one at a time.
    """
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = b.agg(F.sum(F.regexp_count("text", F.lit(_ITEM_WORD)))).first()[0] or 0
    n = -(-total // block_words) or 1
    if n == 1:
        return [Phrases.of([(r.item_id, r.text) for r in b.collect()], window)]
    folder, held = scratch(benchmark.sparkSession, "phrases"), []
    fs, path = filesystem(folder)
    fs.create_dir(path)
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        with fs.open_output_stream(f"{path}/{k}") as f:
            f.write(pickle.dumps(Phrases.of([(r.item_id, r.text) for r in part], window)))
        held.append(f"{folder}/{k}")
    return held


def find(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, item ids that occur, and merged removal spans (code points)."""
    tune(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_report(phrase_blocks(benchmark, window, block_words), shard_bytes), REPORT)


def remove(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with every occurrence of a phrase cut from ``text``; all columns stay."""
    tune(documents.sparkSession)
    return documents.mapInArrow(_clean(phrase_blocks(benchmark, window, block_words), shard_bytes), documents.schema)


def digest(report: DataFrame) -> DataFrame:
    """The report as one row per document with a hash of its items."""
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return report.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
