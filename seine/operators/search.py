"""A specification over a corpus: file selection, narrowing, matching, records."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions import paths as P
from seine.operators import index as I
from seine.operators import lines as L
from seine.operators import modes as M
from seine.operators import render
from seine.plans import regex as R
from seine.sources import shared, tree
from seine.spec import SearchSpec, UsageError, parse_argv

#: Most candidates that come to the driver as paths.
FEW = 500
#: Bytes of a corpus from which on records are written before they are sorted.
MUCH = 64 << 20
#: A NUL within so many bytes makes a file binary as a whole; a later one ends the search at a multiple of it.
FILL = 64 << 10


class Selection:
    """Which files a specification searches, and under which of its operands: predicates on paths alone."""

    def __init__(self, corpus: DataFrame, spec: SearchSpec, rules: list[P.Rule] | None = None) -> None:
        path, types = F.col("path"), P.type_table(spec.type_changes)
        keep = ~P.excluded(path) & ~P.ignored(path, rules or [])
        keep &= P.overridden(path, list(spec.globs), spec.glob_fold) & P.overridden(path, list(spec.iglobs), True)
        keep &= P.typed(path, list(spec.types), list(spec.types_not), types)
        of_type = P.typed(path, list(spec.types), [], types) if spec.types else F.lit(False)
        # A sweep knows which hidden names ignore files show; else names tell.
        told = F.col("hidden") if "hidden" in corpus.columns else None
        conditions, self._under = [], []
        for operand in spec.operands or (".",):
            rest = P.below(path, operand)
            own = keep & (F.size(F.split(rest, "/")) <= spec.max_depth) if spec.max_depth is not None else keep
            visible = F.lit(True) if spec.hidden else P.shown(rest, list(spec.globs), list(spec.iglobs), spec.glob_fold, of_type)
            # A file named is searched whatever the filters.
            if told is None or spec.hidden:
                conditions.append(P.under(path, operand) & ((own & visible) | (path == operand)))
                self._under.append(conditions[-1])
            else:
                conditions.append(P.under(path, operand) & ((own & (visible | ~told)) | (path == operand)))
                self._under.append(P.under(path, operand) & (own | (path == operand)))  # on paths alone
        self.corpus, self.spec = corpus, spec
        self.named = path.isin(*spec.operands) if spec.operands else F.lit(False)
        self.files = corpus.where(reduce(Column.__or__, conditions))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``operand``, once for each operand that holds their path."""
        if len(self._under) == 1:
            return rows.withColumn("operand", F.lit(0))
        held = F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(self._under)])
        return rows.withColumn("operand", F.explode(F.filter(held, lambda k: k.isNotNull())))

    def missing(self) -> list[str]:
        """Operands that the corpus has nothing of."""
        if not self.spec.operands:
            return []
        path = F.col("path")
        here = self.corpus.agg(*[F.coalesce(F.bool_or(P.under(path, o)), F.lit(False)).alias(f"o{k}") for k, o in enumerate(self.spec.operands)]).first()
        return [o for k, o in enumerate(self.spec.operands) if not here[k] and o not in (".", "")]


def select(corpus: DataFrame, spec: SearchSpec, rules: list[P.Rule] | None = None) -> DataFrame:
    """Files that the specification searches, with ``operand`` (a file once for each operand that holds it)."""
    chosen = Selection(corpus, spec, rules)
    return chosen.placed(chosen.files)


def checked(spec: SearchSpec) -> None:
    """Refuse patterns that can't be searched for as asked."""
    if spec.pcre or spec.fixed:
        for p in spec.patterns if spec.fixed else ():
            if "\n" in p and not spec.multiline and spec.terminator != "nul":
                raise R.RegexError("the literal line feed isn't allowed outside multiline mode")
        return
    for p in spec.patterns:
        a = R.analyse(p)
        if a.newline and not spec.multiline and spec.terminator != "nul":
            raise R.RegexError("the literal line feed isn't allowed outside multiline mode")
        if (a.nul or "\0" in p) and not spec.text:
            raise R.RegexError("a NUL isn't allowed but in text")


def pattern(spec: SearchSpec) -> str:
    """All patterns as one."""
    checked(spec)
    if not spec.patterns:
        return "(?!)"
    return spec.patterns[0] if len(spec.patterns) == 1 else L.alternation(list(spec.patterns), spec.fixed)


def plan(spec: SearchSpec) -> list[list[list[int]]] | None:
    """Trigram groups of all patterns; None where narrowing would be unsound or useless."""
    if spec.invert or spec.passthru or spec.include_zero or spec.mode == "without" or not spec.patterns:
        return None
    if spec.pre or spec.encoding not in ("auto", "none", "utf-8", "utf8", "UTF-8"):
        return None
    groups: list = []
    for p in spec.patterns:
        got = R.plan(p, spec.fixed, spec.ignore_case, spec.unicode, spec.pcre)
        if got is None:
            return None
        groups += got
    return groups


@dataclass
class Found:
    """``rows`` depend on the mode; ``text`` has one ``out`` for every printed record, in order."""

    rows: DataFrame
    #: Gives ``text``, which may take a job.
    make: Callable[[], DataFrame]
    spec: SearchSpec
    selection: Selection | None = None
    counters: DataFrame | None = None
    #: Files with a match, where rows don't tell (an empty match has no record).
    hits: DataFrame | None = None
    _missing: list[str] | None = field(default=None, repr=False)

    @cached_property
    def text(self) -> DataFrame:
        return self.make()

    def lines(self) -> list[str]:
        """Printed records (streamed to the driver in order), and the statistics where they are asked for."""
        began, spec = time.time(), self.spec
        out = [] if spec.quiet else [r.out for r in self.text.toLocalIterator()]
        if self.counters is None:
            return out
        c = self.counters.first().asDict()
        c["bytes_printed"] = sum(len(x.encode()) + 1 for x in out) if spec.mode in ("lines", "json") else 0
        seconds = time.time() - began
        if spec.mode == "json":
            return [*out, json.dumps(M.json_summary(c, seconds), sort_keys=True)]
        told = ("matches", "matched_lines", "searches_with_match", "searches", "bytes_printed", "bytes_searched")
        names = ("matches", "matched lines", "files contained matches", "files searched", "bytes printed", "bytes searched")
        return [*out, "", *(f"{c[k]} {n}" for k, n in zip(told, names)), f"{seconds:.6f} seconds spent searching", f"{seconds:.6f} seconds total"]

    def errors(self) -> list[str]:
        """Messages on operands that are not there, or on a search of nothing."""
        if self._missing is None:
            self._missing = self.selection.missing() if self.selection else []
        told = [f"{o}: No such file or directory (os error 2)" for o in self._missing]
        if not told and self.selection and not self.spec.operands and self.spec.mode != "types" and self.selection.files.isEmpty():
            told = ["No files were searched, which means that a filter is applied that selects none"]
        return told

    def exit_code(self) -> int:
        """0 for a hit, 2 for any error (unless a quiet search has a hit), else 1."""
        rows = self.rows if self.hits is None else self.hits
        hits = rows.where("is_match") if "is_match" in rows.columns else rows.where("n > 0") if "n" in rows.columns else rows
        hit = not hits.isEmpty()
        if hit and self.spec.quiet:
            return 0
        return 2 if self.errors() else 0 if hit else 1


def _nothing(corpus: DataFrame, spec: SearchSpec) -> Found:
    none = corpus.sparkSession.createDataFrame([], "path string, operand int, out string")
    return Found(none, lambda: none.select("out"), spec)


def _prepared(files: DataFrame, named: Column, spec: SearchSpec) -> DataFrame:
    """``content`` as it is searched, ``shown`` what of it may be printed, ``nul`` the byte offset of the first NUL.

    Files named on the command line, and all under ``convert``, are searched
    whole with NULs as line feeds, but no line is printed from the fill on that
    holds the first; others are searched up to that fill, and dropped if it is
    the first fill, or if a mode counts and so reads on.
    """
    if spec.text:
        return files.withColumns({"nul": F.lit(None).cast("long"), "shown": F.col("content")})
    at = F.locate("\x00", F.col("content"))
    nul = F.when(at > 0, F.octet_length(F.substring(F.col("content"), F.lit(1), at - 1)).cast("long"))
    convert = F.lit(True) if spec.binary == "convert" else named
    whole = F.lit(spec.mode in ("count", "count_matches", "without") or spec.include_zero)
    cut = F.substring(F.col("content").cast("binary"), F.lit(1), F.floor(F.col("nul") / FILL).cast("int") * FILL)
    # Up to the last line feed, so that a line is whole.
    shown = F.regexp_replace(F.decode(cut, "UTF-8"), "(?s)[^\n]*\\z", "")
    out = files.withColumn("nul", nul).where(F.col("nul").isNull() | convert | (~whole & (F.col("nul") >= FILL)))
    out = out.withColumn("shown", F.when(F.col("nul").isNull(), F.col("content")).otherwise(shown))
    content = F.when(F.col("nul").isNull(), F.col("content")).when(convert, F.translate("content", "\x00", "\n")).otherwise(F.col("shown"))
    return out.withColumn("content", content).withColumn("notice", F.when(convert, F.lit("binary file matches")).otherwise(F.lit("WARNING: stopped searching binary file after match")))


def run(corpus: DataFrame, spec: SearchSpec, rules: list[P.Rule] | None = None, index: I.Index | None = None, load=None) -> Found:
    """Search (path, content[, mtime]).

    An index narrows the files by their paths alone. ``load`` adds ``content``
    to a corpus that has none, so that only files that are left are read.
    """
    spark = corpus.sparkSession
    if spec.mode == "types":
        rows = [(k, f"{k}: {', '.join(sorted(v))}") for k, v in sorted(P.type_table(spec.type_changes).items())]
        listed = spark.createDataFrame(rows, "path string, out string").withColumn("operand", F.lit(0))
        return Found(listed, lambda: listed.orderBy("path").select("out"), spec)
    chosen = Selection(corpus, spec, rules)
    files = chosen.files
    if spec.mode == "listing":
        got = chosen.placed(files.where(P.matches(F.col("path"), spec.listing or "**")).select("path")).distinct()
        return Found(got, lambda: _ordered(got, spec, render.record(spec, render.path(spec)), files), spec, chosen)
    if spec.max_count == 0 or (not spec.patterns and not spec.invert):
        return _nothing(corpus, spec)
    groups = plan(spec) if index and spec.use_index and not index.no_index else None
    if groups is not None:
        candidates = index.candidates(groups, binary=spec.binary != "quit" or bool(spec.operands), zipped=spec.zip)
        # So few paths are a predicate; more are joined, which may shuffle what the corpus holds.
        few = [r.path for r in candidates.limit(FEW + 1).collect()]
        files = files.where(F.col("path").isin(few) if few else F.lit(False)) if len(few) <= FEW else files.join(candidates, "path", "left_semi")
    if load is not None:
        files = load(files)
    options = {"ignore_case": spec.ignore_case, "word": spec.bound == "word", "line": spec.bound == "line", "unicode": spec.unicode}
    p = pattern(spec)
    options |= {"fixed": True} if spec.fixed and len(spec.patterns) == 1 else {}
    whole_files = spec.invert or spec.passthru or spec.include_zero or spec.mode == "without" or spec.stats
    # A cheap test of contents for a literal comes first where only files with a match count.
    if not whole_files and not spec.multiline:
        files = L.holding(files, p, **options)
    files = _prepared(files, chosen.named, spec)
    base = lambda of, ends=False: L.lines(of, spec.terminator, ends)

    def marked(of: DataFrame, ends: bool = False) -> DataFrame:
        if spec.multiline:
            hit = L.multiline_lines(of, p, spec.dotall, **options).select("path", "line_no", F.lit(True).alias("_hit"))
            m = base(of, ends).join(hit, ["path", "line_no"], "left").withColumn("is_match", F.coalesce("_hit", F.lit(False)) != F.lit(spec.invert)).drop("_hit")
        else:
            m = L.marked(base(of, ends), p, spec.invert, **options)
        if spec.max_count is not None:
            m = L.max_count(m, spec.max_count)
        return L.stop_on_nonmatch(m) if spec.stop_on_nonmatch else m

    counters = M.stats(files, marked(files), p, **options) if spec.stats or spec.mode == "json" else None
    found = lambda rows, make, hits=None: Found(rows, make, spec, chosen, counters, hits)
    simple = not (spec.multiline or spec.invert or spec.max_count is not None)
    matched = files.where(M.anywhere(p, spec.terminator, **options)).select("path") if simple else marked(files).where("is_match").select("path").distinct()
    if spec.quiet and spec.mode != "without":
        rows = chosen.placed(matched if counters is not None else matched.limit(1))
        return found(rows, lambda: rows.select(F.lit("").alias("out")).limit(0))
    if spec.mode in ("count", "count_matches"):
        m = marked(files)
        n = M.count_lines(m) if spec.mode == "count" or spec.invert else M.count_matches(m.where("is_match"), p, **options)
        if spec.include_zero:
            n = files.select("path").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
        rows = chosen.placed(n)
        return found(rows, lambda: _ordered(rows, spec, render.count(spec), chosen.files))
    if spec.mode in ("files", "without"):
        rows = chosen.placed(matched if spec.mode == "files" else files.select("path").join(matched, "path", "left_anti"))
        return found(rows, lambda: _ordered(rows, spec, render.record(spec, render.path(spec)), chosen.files))
    if spec.mode == "json":
        events = M.json_events(marked(files, True), p, spec.replacement, spec.before, spec.after, **options)
        rows = chosen.placed(events)
        order = [F.col("operand"), P.order_key(F.col("path")), F.col("ord")]
        return found(rows.withColumn("n", (F.col("ord") > 0).cast("int")), lambda: _once(rows, spec, chosen.files).orderBy(*order).select(F.col("event").alias("out")))
    part = files.withColumn("content", F.col("shown")).where("content <> ''") if not spec.text else files
    m = marked(part, spec.byte_offset)
    m = L.with_offsets(m) if spec.byte_offset else m
    near = m if spec.passthru else L.context(m, spec.before, spec.after) if spec.before or spec.after else m.where("is_match")
    rows = chosen.placed(render.lines(near, spec, p, options))
    notices = None if spec.text else chosen.placed(_notices(files, marked, simple, p, spec, options))
    return found(rows, lambda: _printed(rows, notices, spec, chosen.files), matched)


def _notices(files: DataFrame, marked, simple: bool, p: str, spec: SearchSpec, options: dict) -> DataFrame:
    """(path, out): what is said of a binary file with a match."""
    binary = files.where("nul is not null")
    hit = binary.where(M.anywhere(p, spec.terminator, **options)) if simple else binary.join(marked(binary).where("is_match").select("path").distinct(), "path", "left_semi")
    told = F.concat(F.col("notice"), F.lit(' (found "\\0" byte around offset '), F.col("nul").cast("string"), F.lit(")"))
    return hit.select("path", F.concat(render.prefix(spec, F.lit(": "), F.lit(": ")), told).alias("out"))


def _printed(rows: DataFrame, notices: DataFrame | None, spec: SearchSpec, files: DataFrame) -> DataFrame:
    """Records of all files in order, with what stands between them."""
    sub = F.col("sub") if "sub" in rows.columns else F.lit(0)
    text = rows.select("operand", "path", F.col("line_no").cast("double").alias("at"), sub.cast("int").alias("sub"), "out")
    first = 0  # records of separators before the first file
    if (spec.before or spec.after) and not spec.passthru and spec.group_separator is not None:
        g = L.grouped(rows.select("operand", "path", "line_no").distinct()) if len(spec.operands) < 2 else _grouped(rows)
        g = g.groupBy("operand", "path", "grp").agg(F.min("line_no").alias("first"))
        g = g.where("grp > 1") if spec.heading else g
        text = text.union(g.select("operand", "path", F.col("first") - 0.5, F.lit(0), F.lit(spec.group_separator)))
        first = 0 if spec.heading else 1
    if notices is not None:
        text = text.union(notices.select("operand", "path", F.lit(2.0**60), F.lit(0), "out"))
    if spec.heading:
        heads = text.select("operand", "path").distinct()
        text = text.union(heads.select("operand", "path", F.lit(-2.0), F.lit(0), F.lit("")))
        if spec.with_path is not False:
            text = text.union(heads.where(render.named(spec)).select("operand", "path", F.lit(-1.0), F.lit(0), render.path(spec)))
        first = 1
    order = _file_order(spec, files)
    text = text.join(files.select("path", "mtime").distinct(), "path") if order[0] == "mtime" else text
    text = _once(text, spec, files).orderBy(*order[1], "at", "sub")
    return _cut((text.offset(first) if first else text).select("out"), spec)


def _grouped(rows: DataFrame) -> DataFrame:
    """Groups of adjacent lines, which are the same under every operand."""
    own = rows.select("path", "operand").distinct()
    return L.grouped(rows.select("path", "line_no").distinct()).join(own, "path")


def _once(rows: DataFrame, spec: SearchSpec, files: DataFrame) -> DataFrame:
    """Records of much text, written: a sort computes what it sorts twice, first to find its ranges."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size < MUCH or spec.limit is not None or spec.mode == "listing" else shared.written(rows, "records")


def _cut(text: DataFrame, spec: SearchSpec) -> DataFrame:
    text = text.offset(spec.offset) if spec.offset else text
    return text.limit(spec.limit) if spec.limit is not None else text


def _file_order(spec: SearchSpec, files: DataFrame) -> tuple[str, list[Column]]:
    """The columns that order files: by a time, if the corpus has it, or by operand and path."""
    key = P.order_key(F.col("path"))
    if spec.sort in ("modified", "accessed", "created") and "mtime" in files.columns:
        return "mtime", [F.col("mtime").desc_nulls_first() if spec.reverse else F.col("mtime").asc_nulls_last(), key]
    return "path", [F.col("operand").desc(), key.desc()] if spec.reverse else [F.col("operand"), key]


def _ordered(rows: DataFrame, spec: SearchSpec, out: Column, files: DataFrame) -> DataFrame:
    by, order = _file_order(spec, files)
    if by == "mtime":
        times = {"modified": "mtime", "accessed": "atime", "created": "ctime"}[spec.sort]
        times = times if times in files.columns else "mtime"
        rows = rows.join(files.select("path", F.col(times).alias("mtime")).distinct(), "path")
    rows = rows.withColumn("out", out)
    return _cut(_once(rows, spec, files).orderBy(*order).select("out"), spec)


def search_tree(spark: SparkSession, root: str, argv: list[str] | SearchSpec, index: I.Index | None = None) -> Found:
    """A command line over the files below a folder that every executor sees."""
    spec = argv if isinstance(argv, SearchSpec) else parse_argv(argv)
    if spec.encoding not in ("auto", "none"):
        try:
            b"".decode(spec.encoding)
        except LookupError:
            raise UsageError(f"unknown encoding: {spec.encoding}") from None
    scopes = [o for o in spec.operands if o != "."] if "." not in spec.operands else []
    files = tree.sweep(spark, root, scopes or None, **tree.toggles(spec))
    live = spec.follow or spec.ignore != SearchSpec().ignore or spec.one_file_system
    load = lambda f: tree.with_content(f, root, spec.zip, spec.pre.split() or None, list(spec.pre_globs) or None, spec.encoding)
    return run(files, spec, index=None if live else index, load=load)
