"""Chat formatting by a grammar that is parsed back.

    turn := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

A turn is rendered, reparsed by the deterministic parser, and compared with its
source; content that doesn't come back the same is escaped and tried again
until it does. In a text an escape adds one backslash to every ``<\\...|`` (any
number of backslashes), which the parser takes off again, so that no control
string is left inside. In a role, ``%``, line breaks and ``<`` become ``%xx``.

Turns render alone, so a conversation of any length is spread over tasks; only
the reader folds a conversation, turn by turn, holding one at a time.

Defined cases: a null role or text is empty; rows of equal turn keep the order
of role, then text; repeated rows are turns of their own; a null conversation
id is one conversation; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.session import tune

START, END = "<|im_start|>", "<|im_end|>"
_ADD = re.compile(r"<(\\*)\|")
_DROP = re.compile(r"<(\\*)\\\|")
_ROLE = re.compile(r"[%\n<]")
_UNROLE = re.compile(r"%([0-9a-f]{2})")


def escape(text: str) -> str:
    return _ADD.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _DROP.sub(r"<\1|", text)


def _render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


class GrammarError(ValueError):
    pass


class Parser:
    """Incremental parser: ``feed`` returns the (role, text) turns that are complete."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, chunk: str) -> list[tuple[str, str]]:
        s, at, out = self.rest + chunk, 0, []
        while at < len(s):
            if not s.startswith(START, at):
                if START.startswith(s[at:]):
                    break
                raise GrammarError(f"a turn has to begin with {START}")
            line = s.find("\n", at)
            end = s.find(END, line + 1) if line >= 0 else -1
            if end < 0 or end + len(END) >= len(s):
                break
            if s[end + len(END)] != "\n":
                raise GrammarError("a turn has to end with a line break")
            if "<" in s[at + len(START) : line] or START in s[line + 1 : end]:
                raise GrammarError("a control string inside a turn")
            role = _UNROLE.sub(lambda m: chr(int(m[1], 16)), s[at + len(START) : line])
            out.append((role, unescape(s[line + 1 : end])))
            at = end + len(END) + 1
        self.rest = s[at:]
        return out

    def close(self) -> None:
        if self.rest:
            raise GrammarError("the last turn is not complete")


def parse(rendered: str) -> list[tuple[str, str]]:
    p = Parser()
    turns = p.feed(rendered)
    p.close()
    return turns


def render(role: str | None, text: str | None) -> str:
    """A turn whose parse is its source: escaped only where it has to be."""
    role, text = role or "", text or ""
    safe_role, safe_text = _ROLE.sub(lambda m: f"%{ord(m[0]):02x}", role), escape(text)
    for r, t in ((role, text), (role, safe_text), (safe_role, safe_text)):
        out = _render(r, t)
        try:
            if parse(out) == [(role, text)]:
                return out
        except GrammarError:
            pass
    raise GrammarError(f"no rendering of this turn parses back: {role!r}")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        yield pa.record_batch([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text_hash"), pa.array(out, pa.string())], names=["conv_id", "turn", "role", "text_hash", "formatted"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rendered turns: conv_id, turn, role, text_hash (order among equal turns), formatted."""
    tune(conversations.sparkSession)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_rendered, "conv_id long, turn long, role string, text_hash long, formatted string")


class _Fold:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.parser = conv_id, Parser()
        self.turns = self.loss = self.size = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, chunk: str, loss_role: str) -> None:
        self.size += len(chunk)
        for role, text in self.parser.feed(chunk):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == loss_role:
                self.loss += len(text)
                self.masked.update(text.encode())

    def row(self) -> dict:
        self.parser.close()
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.masked.hexdigest(), "formatted_chars": self.size}


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _folded(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Fold | None = None
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Fold(conv)
                now.add(text, loss_role)
            yield pa.RecordBatch.from_pylist(rows, _READ)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], _READ)

    return run


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Per conversation, parsed from its rendered turns: digests of all turns and of those under the loss mask."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_hash")
    return ordered.select("conv_id", "formatted").mapInArrow(_folded(loss_role), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation(formatted: DataFrame) -> DataFrame:
    """Whole rendered conversations (for tables whose conversations are known to be short)."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text_hash", "formatted")))
    return formatted.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: x["formatted"])).alias("formatted"))
