"""Records as they are printed: fields, separators, colours, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import paths as P
from seine.operators import lines as L
from seine.plans import regex as R
from seine.spec import SearchSpec

_RESET = "\x1b[0m"
_STYLES = {"path": "\x1b[35m", "line": "\x1b[32m", "match": "\x1b[1m\x1b[31m"}
_ALIASES = {"default": "file://{host}{path}", "none": "", "file": "file://{host}{path}", "vscode": "vscode://file{path}:{line}:{column}"}


def styled(spec: SearchSpec, what: str, text: Column) -> Column:
    return F.concat(F.lit(_RESET + _STYLES[what]), text, F.lit(_RESET)) if spec.color else text


def path(spec: SearchSpec) -> Column:
    """A path with the separator that was asked for."""
    p = F.col("path")
    return styled(spec, "path", linked(spec, p if spec.path_separator == "/" else F.translate(p, "/", spec.path_separator)))


def linked(spec: SearchSpec, text: Column) -> Column:
    """A terminal link to the file, where a format is given and colours are on."""
    form = _ALIASES.get(spec.hyperlink, spec.hyperlink)
    if not form or not spec.color:
        return text
    line = F.col("line_no").cast("string") if "{line}" in form else F.lit("1")
    out: list[Column] = []
    for k, piece in enumerate(form.replace("{host}", spec.hostname).replace("{column}", "1").split("{path}")):
        if k:
            out.append(F.concat(F.lit("/"), F.col("path")))
        for n, text_ in enumerate(piece.split("{line}")):
            out += [line] if n else []
            out.append(F.lit(text_))
    return F.concat(F.lit("\x1b]8;;"), *out, F.lit("\x1b\\"), text, F.lit("\x1b]8;;\x1b\\"))


def named(spec: SearchSpec) -> Column:
    """Whether records of a path are printed with it: not if it is the one operand itself, unless asked for."""
    if spec.with_path is not None:
        return F.lit(spec.with_path)
    return F.col("path") != spec.operands[0] if len(spec.operands) == 1 else F.lit(True)


def prefix(spec: SearchSpec, separator: Column, null: Column | None = None) -> Column:
    """The path and what parts it from the rest of a record."""
    end = F.lit("\x00") if spec.null and null is None else separator
    return F.when(named(spec), F.concat(path(spec), end)).otherwise(F.lit(""))


def record(spec: SearchSpec, out: Column) -> Column:
    """A path as a record of its own."""
    return F.concat(out, F.lit("\x00")) if spec.null else out


def count(spec: SearchSpec) -> Column:
    return F.concat(prefix(spec, F.lit(":")), F.col("n").cast("string"))


def lines(near: DataFrame, spec: SearchSpec, p: str, options: dict) -> DataFrame:
    """Lines (path, line_no, line, is_match[, byte_offset]) with ``out``, a row for every record."""
    line, column, offset = F.col("line"), L.column(p, **options), F.col("byte_offset")
    each = spec.only and not spec.invert
    if each or spec.vimgrep:
        placed = spec.column or spec.byte_offset or not each  # where a match is matters
        found = L.pieces(p, **options) if placed else F.transform(F.regexp_extract_all("line", F.lit(R.java(p, **options)), F.lit(0)), lambda x: F.struct(x.alias("match")))
        found = F.filter(found, lambda x: x["match"] != "") if each else found
        hits = near.where("is_match").select("*", F.posexplode(found).alias("sub", "x"))
        if spec.vimgrep and not each and (spec.before or spec.after or spec.invert):
            rest = near.where("not is_match" if not spec.invert else "true").select("*", F.lit(0).alias("sub"), F.lit(None).cast("struct<start:int,end:int,match:string>").alias("x"))
            hits = rest if spec.invert else hits.union(rest)
        near = hits
        column = F.coalesce(F.col("x.start") + 1, F.lit(1)) if placed else column
        if each:
            line = F.col("x.match") if spec.replacement is None else L.replaced(p, spec.replacement, of=F.col("x.match"), **options)
            offset = offset + F.col("x.start") if placed else offset
    if spec.replacement is not None and not each:
        line = F.when(F.col("is_match"), L.replaced(p, spec.replacement, **options)).otherwise(line)
    line = L.trimmed(line) if spec.trim else line
    if spec.color and spec.replacement is None and not spec.invert:
        to = F.concat(F.lit(_RESET + _STYLES["match"]), line, F.lit(_RESET)) if each else F.regexp_replace(line, R.java(p, **options), f"{_RESET}{_STYLES['match']}$0{_RESET}")
        line = F.when(F.col("is_match"), to).otherwise(line)
    if spec.max_columns:
        note = L.limited(spec.max_columns, spec.preview, line)
        line = note if spec.preview else F.when(F.col("is_match"), note).otherwise(F.when(F.octet_length(line) > spec.max_columns, F.lit("[Omitted long context line]")).otherwise(line))
    sep = F.when(F.col("is_match"), F.lit(spec.match_separator)).otherwise(F.lit(spec.context_separator))
    parts = [] if spec.heading else [prefix(spec, sep)]
    if spec.line_numbers:
        parts += [styled(spec, "line", F.col("line_no").cast("string")), sep]
    if spec.column:
        parts.append(F.when(F.col("is_match"), F.concat(column.cast("string"), sep)).otherwise(F.lit("")))
    if spec.byte_offset:
        parts += [offset.cast("string"), sep]
    return near.withColumn("out", F.concat(*parts, line))


def display(spec: SearchSpec, folder: str) -> Column:
    """A path as seen from a folder of the corpus."""
    return P.display(F.col("path"), folder, spec.path_separator)
