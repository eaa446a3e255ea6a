"""Token ids with the tokenizers library, memoised by pre-token.

Both vocabularies cut a text into pre-tokens first and encode each alone. For
texts of common characters the cut is made here, by an equal regular expression
or, at byte level, by table look-ups over the bytes of many texts at once, and
the library encodes each distinct pre-token once per worker. Any other text
(rare characters, special-token strings) is given to the library whole, so ids
are the library's for every text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
#: Letters, digits, white space and marks whose classes are beyond doubt, composed, with one-to-one lower case.
_UNSAFE = re.compile(f"[^\\n\\t\\r -~{_LETTERS}¿¡«»–—‘’“”…€]|<\\|")
_WORD_END = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: Of each byte of safe texts, the class of the character that it begins: white space, letter, digit, other.
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 13, 32]] = _WHITE
_KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC5]] = _LETTER
_KIND[48:58] = _DIGIT
#: Bytes as the characters of a byte-level vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(_SHOWN, _SHOWN)) | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
#: Pre-tokens in each of the memo's two generations; at byte level it has one, of pre-tokens of at most ``LONG`` bytes,
#: and beyond so many the better half stays.
MEMO = 300_000
LONG = 64


def large_binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The parts of an array that byte offsets give (one more than parts), not copied."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64, copy=False)), pa.py_buffer(values)])


def binary(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: bytes and offsets."""
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_level_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens of safe texts begin, which lie one after another in ``raw``, cut at ``at``.

    The vocabulary's rule: `` ?`` and a run of letters, of digits or of others;
    of white space before another character the last is apart; ``'s``, ``'t``,
    ``'re``, ``'ve``, ``'m``, ``'ll`` and ``'d`` where a pre-token begins.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[raw]
    rest = np.flatnonzero((raw & 0xC0) == 0x80)
    for _ in range(2):  # characters have three bytes at most
        kind[rest] = kind[rest - 1]
    same_text = np.ones(n, bool)  # as the byte before
    same_text[at[:-1][at[:-1] < n]] = False
    start = ~same_text
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == _WHITE
    after = start[1:] & same_text[1:] & ~white[1:] & white[:-1]
    start[:-1] |= after
    start[1:] &= ~(after & (raw[:-1] == 32))
    quote = np.flatnonzero(start & (raw == 39))
    if len(quote):
        left = at[np.searchsorted(at, quote, "right")] - quote
        ahead = np.append(raw, [0, 0])
        one, two = ahead[quote + 1], ahead[quote + 2]
        size = np.where(np.isin(one, list(b"stmd")), 2, 0)
        size[((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))] = 3
        size[size > left] = 0
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        end = quote + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """``ids`` of a text as little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.lower = type(self.library.pre_tokenizer).__name__ == "Sequence"
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.last = np.zeros(self.size, bool)  # ids that end a pre-token, if ids tell
        if self.lower:
            for token, i in self.library.get_vocab(with_added_tokens=True).items():
                self.last[i] = token.endswith("</w>")
        self.keys = self.values = pa.array([], pa.large_binary())  # the memo at byte level, and how often each was used
        self.uses = np.zeros(0, np.int64)

    def _pretokens(self, texts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded as one text in which each stays one, as words end at their last ids."""
        ids = np.array(self.library.encode(" ".join(texts), add_special_tokens=False).ids, self.dtype)
        end = np.flatnonzero(self.last[ids]) + 1
        start = np.concatenate([[0], end[:-1]])
        if len(end) != len(texts):
            return self._whole(texts)
        raw, size = ids.tobytes(), self.dtype.itemsize
        return [raw[a:b] for a, b in zip((start * size).tolist(), (end * size).tolist())]

    def _byte_pretokens(self, texts: pa.Array) -> pa.Array:
        """Ids of byte-level pre-tokens by the library's model, which takes one at a time."""
        raw, at = binary(texts)
        shown, model = raw.tobytes().decode("latin-1").translate(_BYTES), self.library.model.tokenize
        ids, ends, a = [], [0], 0
        for b in at[1:].tolist():
            ids += [x.id for x in model(shown[a:b])]
            ends.append(len(ids))
            a = b
        return large_binary(np.array(ids, self.dtype), np.array(ends) * self.dtype.itemsize)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_WORD_END.findall(t.lower()) for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        missing = []
        for t in set().union(*cut).difference(self.memo):
            if (known := self.older.get(t)) is not None:
                self.memo[t] = known
            else:
                missing.append(t)
        for k in range(0, len(missing), 4096):
            part = missing[k : k + 4096]
            self.memo.update(zip(part, self._pretokens(part)))
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), self.dtype) for c in cut]

    def _bytes(self, texts: list[str]) -> list[np.ndarray]:
        each = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, each)])
        raw = np.frombuffer(b"".join(each), np.uint8)
        start = byte_level_starts(raw, at)
        held = len(self.keys)
        # What the memo holds keeps its numbers; pre-tokens not in it get the next ones.
        coded = pa.concat_arrays([self.keys, large_binary(raw, np.append(start, len(raw)))]).dictionary_encode()
        keys, which = coded.dictionary, coded.indices.slice(held)
        values = pa.concat_arrays([self.values, self._byte_pretokens(keys.slice(held))])
        flat, ends = binary(values.take(which))
        flat, ends = flat.view(self.dtype), ends[np.searchsorted(start, at)] // self.dtype.itemsize
        self._remember(keys, values, np.bincount(which.to_numpy(), minlength=len(keys)))
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _remember(self, keys: pa.Array, values: pa.Array, uses: np.ndarray) -> None:
        """Keep what was used most, the older uses counting less."""
        uses[: len(self.uses)] += self.uses
        keep = np.diff(binary(keys)[1]) <= LONG
        if len(keys) > MEMO:
            keep &= uses > np.partition(uses, -(MEMO // 2))[-(MEMO // 2)]
            uses >>= 1
        if not keep.all():
            keys, values, uses = keys.filter(pa.array(keep)), values.filter(pa.array(keep)), uses[keep]
        self.keys, self.values, self.uses = keys, values, uses

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        texts = [t or "" for t in texts]
        unsafe = [_UNSAFE.search(t) is not None for t in texts]
        cut = iter((self._words if self.lower else self._bytes)([t for t, u in zip(texts, unsafe) if not u]))
        whole = iter(self._whole([t for t, u in zip(texts, unsafe) if u]))
        return [np.frombuffer(next(whole), self.dtype) if u else next(cut) for u in unsafe]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
