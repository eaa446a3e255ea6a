"""Real file trees: a sweep with ignore rules, and contents read on the executors."""

from __future__ import annotations

import fnmatch
import gzip
import itertools
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions.paths import Rule
from seine.sources import shared
from seine.spec import SOURCES, SearchSpec

#: Ignore files of a folder by source; of one folder the later file wins.
IGNORE_FILES = {"vcs": (".gitignore",), "dot": (".ignore", ".rgignore")}
SKIP = (".git", ".seine")
#: Files of a batch that a sweep gives.
CHUNK = 4096
FILES = "path string, mtime long, atime long, ctime long, size long, hidden boolean"
_TYPES = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
#: (what to put before a path, rule): later ones win.
Rules = list[tuple[str, Rule]]


def _read(file: str, base: str = "", fold: bool = False) -> list[Rule]:
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            return [r for line in f if (r := Rule.parse(line, base, fold))]
    except OSError:
        return []


def _rules(folder: str, base: str, sources: frozenset[str]) -> Rules:
    names = [n for source, some in IGNORE_FILES.items() if source in sources for n in some]
    return [("", r) for n in names for r in _read(os.path.join(folder, n), base)]


def _above(root: str) -> Rules:
    """Rules of the ``.ignore`` files of the folders that hold the root, outermost first."""
    out: Rules = []
    at, under = os.path.dirname(os.path.abspath(root)), os.path.basename(os.path.abspath(root)) + "/"
    while True:
        out = [(under, r) for n in IGNORE_FILES["dot"] for r in _read(os.path.join(at, n))] + out
        if os.path.dirname(at) == at:
            return out
        at, under = os.path.dirname(at), os.path.basename(at) + "/" + under


def _drops(rules: Rules, path: str, is_dir: bool) -> bool | None:
    for before, r in reversed(rules):
        if (is_dir or not r.only_dirs) and re.search(r.regex, before + path):
            return not r.negated
    return None


def toggles(spec: SearchSpec) -> dict:
    """The options of a sweep that a specification asks for."""
    return {
        "sources": spec.ignore, "files": spec.ignore_files, "fold": spec.ignore_files_fold, "require_git": spec.require_git,
        "follow": spec.follow, "one_file_system": spec.one_file_system,
    }


def walk(
    root: str, below: str = "", ignore: bool = True, hidden: bool = True, follow: bool = False, max_depth: int | None = None, named: bool = False,
    sources: frozenset[str] = frozenset(SOURCES), files: tuple[str, ...] = (), fold: bool = False, require_git: bool = False, one_file_system: bool = False, stat: bool = True, ordered: bool = True,
) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(path, mtime, atime and ctime in ns, size, hidden) of files, in component order unless not ``ordered``.

    Rules of ancestors hold for a scope; a deeper rule wins, of one folder the
    later file, and any of them over the named ignore ``files``. A rule that
    keeps a hidden name shows it, as does a scope that was ``named`` on purpose.
    Without ``stat`` times and sizes are 0, and files are not touched. An order
    takes the entries of a folder at once.
    """
    if not ignore:
        sources, files = frozenset(), ()
    if require_git and not os.path.exists(os.path.join(root, ".git")):
        sources = sources - {"vcs", "exclude", "global"}
    rules: Rules = [("", r) for f in files for r in _read(os.path.join(root, f), "", fold)]
    if "global" in sources:
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
        rules += [("", r) for r in _read(os.path.join(home, "git", "ignore"))]
    if "exclude" in sources:
        rules += [("", r) for r in _read(os.path.join(root, ".git", "info", "exclude"))]
    if {"parent", "dot"} <= sources:
        rules += _above(root)
    rules += _rules(root, "", sources)
    device = os.stat(root).st_dev if one_file_system else None
    at, dotted = "", False
    if below and os.path.isfile(os.path.join(root, below)):
        s = os.stat(os.path.join(root, below))
        yield below, s.st_mtime_ns, s.st_atime_ns, s.st_ctime_ns, s.st_size, False
        return
    for p in filter(None, below.split("/")):
        at = f"{at}/{p}".lstrip("/")
        said = _drops(rules, at, True)
        dotted |= p.startswith(".") and said is not False and not named
        if (said and not (named and at == below)) or (dotted and not hidden):
            return
        rules = rules + _rules(os.path.join(root, at), at, sources)

    def entries(rel: str) -> Iterator[os.DirEntry]:
        try:
            with os.scandir(os.path.join(root, rel)) as some:
                yield from sorted(some, key=lambda e: e.name) if ordered else some
        except OSError:
            return

    def inner(rel: str, rules: Rules, is_hidden: bool, depth: int) -> Iterator[tuple[str, int, int, int, int, bool]]:
        for e in entries(rel):
            path = f"{rel}/{e.name}".lstrip("/")
            is_dir = e.is_dir(follow_symlinks=follow)
            if e.name in SKIP or (e.is_symlink() and not follow):
                continue
            said = _drops(rules, path, is_dir)
            dot = is_hidden or (e.name.startswith(".") and said is not False)
            if said or (dot and not hidden):
                continue
            if is_dir:
                other = device is not None and e.stat(follow_symlinks=follow).st_dev != device
                if not other and (max_depth is None or depth < max_depth):
                    yield from inner(path, rules + _rules(e.path, path, sources), dot, depth + 1)
            elif e.is_file(follow_symlinks=follow):
                if not stat:
                    yield path, 0, 0, 0, 0, dot
                    continue
                s = e.stat()
                yield path, s.st_mtime_ns, s.st_atime_ns, s.st_ctime_ns, s.st_size, dot

    yield from inner(at, rules, dotted, 1 + at.count("/") + bool(at))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Files as they come, few at a time."""
    while columns := list(zip(*itertools.islice(rows, CHUNK))):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=["path", "mtime", "atime", "ctime", "size", "hidden"])


def sweep(spark: SparkSession, root: str, below: list[str] | None = None, **options) -> DataFrame:
    """Files of a tree that every executor can see; one task for each top-level folder."""
    tops = below or sorted(e.name for e in os.scandir(root) if e.is_dir() and e.name not in SKIP)
    scopes = [(t, False) for t in tops] + ([] if below else [("", True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scope, top in zip(batch.column("scope").to_pylist(), batch.column("top").to_pylist()):
                rows = walk(root, scope, **(options | {"ordered": False} | ({"max_depth": 1} if top else {"named": bool(below)})))
                yield from _batches(rows)

    table = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(scopes)], "k int, scope string, top boolean")
    return table.repartitionById(len(scopes), "k").select("scope", "top").mapInArrow(run, FILES).dropDuplicates(["path"])


def with_content(files: DataFrame, root: str, unzip: bool = False, pre: list[str] | None = None, pre_globs: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """``content`` of every file, read where it is searched.

    ``unzip`` decodes .gz; ``pre`` runs a command with the file on its standard
    input; an encoding, or else a byte-order mark, is decoded.
    """
    def load(path: str) -> str | None:
        full = os.path.join(root, path)
        try:
            if pre and (not pre_globs or any(fnmatch.fnmatch(path, g) for g in pre_globs)):
                with open(full, "rb") as f:
                    raw = subprocess.run([*pre, full], stdin=f, capture_output=True, check=True).stdout
            else:
                with open(full, "rb") as f:
                    raw = f.read()
                if unzip and path.endswith(".gz"):
                    raw = gzip.decompress(raw)
        except (OSError, subprocess.CalledProcessError):
            return None
        if encoding and encoding not in ("auto", "none"):
            return raw.decode(encoding, "replace")
        if encoding != "none":
            for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
                if raw.startswith(mark):
                    return raw[len(mark) :].decode(name, "replace")
        return raw.decode("utf-8", "replace")  # a file that can't be read has no content and is left out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([load(one.column("path")[0].as_py())], pa.string())], names=[*one.schema.names, "content"])

    shared.bounded(files.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{fields}, content string").where(F.col("content").isNotNull())
