"""Lines of files, matches on them, and everything shaped along a file's lines.

A corpus is a DataFrame (path, content, ...); all here are lazy DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.plans import regex

_BLANK = "^[ \\t\\r\\n\\f\\x0b]+"


def _by_file() -> Window:
    return Window.partitionBy("path").orderBy("line_no")


def terminator_of(name: str) -> str:
    return "\x00" if name == "nul" else "\n"


def split_lines(content: Column, terminator: str = "lf") -> Column:
    """The array of a content's lines, without their ends: a last terminator makes no line."""
    end = terminator_of(terminator)
    parts = F.split(F.regexp_replace(content, f"(?s){end}\\z", ""), end, -1)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\\r\\z", "")) if terminator == "crlf" else parts


def lines(corpus: DataFrame, terminator: str = "lf", ends: bool = False) -> DataFrame:
    """(path, line_no, line): from 1; an empty file has none.

    ``lf`` splits at line feeds, ``crlf`` takes a carriage return before them
    (or at the end) off, ``nul`` splits at NULs. With ``ends`` there is ``eol``,
    what ends the line in its file ("" for a last line without a terminator).
    """
    some = corpus.where(F.col("content") != "")
    number = (F.col("n") + 1).cast("long").alias("line_no")
    if not ends:
        return some.select("path", F.posexplode(split_lines(F.col("content"), terminator)).alias("n", "line")).select("path", number, "line")
    end = terminator_of(terminator)
    raw = some.select("path", F.posexplode(split_lines(F.col("content"))).alias("n", "line"), F.col("content").endswith(end).alias("closed"), F.size(split_lines(F.col("content"))).alias("all"))
    if terminator == "nul":
        raw = some.select("path", F.posexplode(split_lines(F.col("content"), "nul")).alias("n", "line"), F.col("content").endswith(end).alias("closed"), F.size(split_lines(F.col("content"), "nul")).alias("all"))
    eol = F.when(F.col("closed") | (F.col("n") + 1 < F.col("all")), F.lit(end)).otherwise("")
    line = F.col("line")
    if terminator == "crlf":
        cr = line.endswith("\r")
        eol, line = F.concat(F.when(cr, "\r").otherwise(""), eol), F.regexp_replace(line, "\\r\\z", "")
    return raw.select("path", number, line.alias("line"), eol.alias("eol"))


def holding(corpus: DataFrame, pattern: str, **options) -> DataFrame:
    """Files that may have a match: those with a literal that every match holds.

    A cheap test of whole contents, so that other files never become lines.
    """
    held = _held(F.col("content"), pattern, **options)
    return corpus if held is None else corpus.where(held)


def _held(column: Column, pattern: str, **options) -> Column | None:
    """Whether a text has a literal that every match holds, where there is one."""
    literals = None if options.get("ignore_case") else regex.required_literals(pattern, bool(options.get("fixed")), pcre=True)
    return reduce(Column.__or__, [column.contains(x) for x in literals]) if literals else None


def with_offsets(rows: DataFrame) -> DataFrame:
    """``byte_offset`` of each line in its file (all of its lines have to be there); lines end in ``eol``, or else in one byte."""
    before = _by_file().rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line") + (F.octet_length("eol") if "eol" in rows.columns else F.lit(1))
    return rows.withColumn("byte_offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def plain(options: dict) -> bool:
    """Whether a fixed string is a plain containment."""
    return bool(options.get("fixed")) and not any(options.get(k) for k in ("ignore_case", "word", "line"))


def matching(column: Column, pattern: str, **options) -> Column:
    """Whether a line matches; a search for a literal comes first, as a pattern is tried at every character."""
    if plain(options):
        return column.contains(pattern)
    held, match = _held(column, pattern, **options), column.rlike(regex.java(pattern, **options))
    return match if held is None else held & match


def marked(rows: DataFrame, pattern: str, invert: bool = False, **options) -> DataFrame:
    m = matching(F.col("line"), pattern, **options)
    return rows.withColumn("is_match", ~m if invert else m)


def alternation(patterns: list[str], fixed: bool = False) -> str:
    """Several patterns as one (an empty one matches everything)."""
    arms = [regex.java(p, True).split(")", 1)[1] if fixed else p for p in patterns]
    return "|".join(f"(?:{a})" for a in arms)


def max_count(m: DataFrame, n: int) -> DataFrame:
    """Matches after the n-th of a file are no matches any more."""
    seen = F.sum(F.col("is_match").cast("int")).over(_by_file().rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("is_match", F.col("is_match") & (seen <= n))


def stop_on_nonmatch(m: DataFrame) -> DataFrame:
    """Lines of a file up to the first that doesn't match after one that does."""
    w = _by_file().rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_seen", F.max("is_match").over(w))
    m = m.withColumn("_stop", F.max(F.col("_seen") & ~F.col("is_match")).over(w))
    return m.where("not _stop").drop("_seen", "_stop")


def context(m: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Matching lines and those around them."""
    near = F.max("is_match").over(_by_file().rowsBetween(-after, before))
    return m.withColumn("_near", near).where("_near").drop("_near")


def grouped(c: DataFrame) -> DataFrame:
    """``grp``: runs of adjacent lines of a file, from 1 (gaps are where separators go)."""
    w = _by_file()
    new = F.coalesce((F.col("line_no") - F.lag("line_no").over(w) > 1).cast("int"), F.lit(1))
    return c.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def pieces(pattern: str, **options) -> Column:
    """Every match of a line in order: (start, end, match), byte offsets in the line.

    What lies between matches alternates with them, so one pass adds up the
    lengths. An empty match right after a match is none.
    """
    java = regex.java(pattern, **options)
    found, between = F.regexp_extract_all("line", F.lit(java), F.lit(0)), F.split("line", java, -1)
    if not options.get("fixed") and regex.can_match_empty(pattern):
        return _empty_pieces(java, found)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("all"))

    def add(acc: Column, pair: Column) -> Column:
        lo = acc["at"] + F.octet_length(pair["b"])
        hi = lo + F.octet_length(pair["f"])
        one = F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"), pair["f"].alias("match"))
        return F.struct(hi.cast("int").alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("f"))
    return F.aggregate(pairs, start, add, lambda acc: acc["all"])


def _empty_pieces(java: str, found: Column) -> Column:
    """As ``pieces`` where matches may be empty: the line is walked match by match."""
    start = F.struct(
        F.lit(0).alias("chars"), F.lit(0).alias("last"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("all")
    )

    def add(acc: Column, m: Column) -> Column:
        # The next match of a non-empty one begins where its text is next; of an empty one, where the walk stands.
        at = F.when(m == "", acc["chars"]).otherwise(F.call_function("locate", m, F.col("line"), acc["chars"] + 1) - 1)
        lo = F.octet_length(F.substring(F.col("line"), F.lit(1), at))
        one = F.struct(lo.cast("int").alias("start"), (lo + F.octet_length(m)).cast("int").alias("end"), m.alias("match"))
        touching = (m == "") & (acc["last"] == 1)
        return F.struct(
            (at + F.when(m == "", F.lit(1)).otherwise(F.length(m))).cast("int").alias("chars"), F.when(m == "", 0).otherwise(1).alias("last"), F.when(touching, acc["all"]).otherwise(F.concat(acc["all"], F.array(one))).alias("all")
        )

    return F.aggregate(found, start, add, lambda acc: acc["all"])


def occurrences(rows: DataFrame, pattern: str, **options) -> DataFrame:
    """(path, line_no, n, match): one row for every non-empty match, in order from 1."""
    found = F.regexp_extract_all("line", F.lit(regex.java(pattern, **options)), F.lit(0))
    hit = rows.where(matching(F.col("line"), pattern, **options))
    return hit.select("path", "line_no", F.posexplode(found).alias("n", "match")).where("match <> ''").withColumn("n", F.col("n") + 1)


def count_column(pattern: str, **options) -> Column:
    """Occurrences in a line; an empty one right after a match is none."""
    java = F.lit(regex.java(pattern, **options))
    if options.get("fixed") or not regex.can_match_empty(pattern):
        return F.regexp_count("line", java)
    # Lengths of successive matches tell which empty ones touch the match before.
    found = F.regexp_extract_all("line", java, F.lit(0))
    touching = F.size(F.filter(F.transform(found, lambda x, i: (x == "") & (i > 0) & (F.get(found, i - 1) != "")), lambda x: x))
    return F.size(found) - touching


def column(pattern: str, **options) -> Column:
    """1-based byte column of the first match."""
    at = F.regexp_instr("line", F.lit(regex.java(pattern, **options)))
    return (F.octet_length(F.substring(F.col("line"), F.lit(1), at - 1)) + 1).cast("int")


def vimgrep(rows: DataFrame, pattern: str, **options) -> DataFrame:
    """One row for every match with its byte column."""
    hit = rows.where(matching(F.col("line"), pattern, **options))
    return hit.select("path", "line_no", F.explode(pieces(pattern, **options)).alias("x"), "line").select("path", "line_no", (F.col("x.start") + 1).alias("col"), "line")


def replaced(pattern: str, replacement: str, of: str = "line", **options) -> Column:
    """The line with every match replaced; ``$1``, ``${name}`` and ``$0`` refer to groups."""
    to = regex.replacement(replacement, pattern, bool(options.get("fixed")), pcre=True)
    return F.regexp_replace(of, regex.java(pattern, **options), to)


def limited(n: int, preview: bool = False, line: Column | None = None) -> Column:
    """Lines of more than ``n`` bytes give a note (0: no limit)."""
    line = F.col("line") if line is None else line
    if not n:
        return line
    note = F.concat(F.substring(line, 1, n), F.lit(" [... omitted end of long line]")) if preview else F.lit("[Omitted long matching line]")
    return F.when(F.octet_length(line) > n, note).otherwise(line)


def trimmed(line: Column | None = None) -> Column:
    return F.regexp_replace(F.col("line") if line is None else line, _BLANK, "")


def multiline(corpus: DataFrame, pattern: str, dotall: bool = False, **options) -> DataFrame:
    """(path, n, match): matches that may span lines, whole texts at a time."""
    java = regex.java(pattern, dotall=dotall, **options)
    found = F.regexp_extract_all("content", F.lit(java), F.lit(0))
    return corpus.where(F.col("content").rlike(java)).select("path", F.posexplode(found).alias("n", "match")).withColumn("n", F.col("n") + 1)


def multiline_lines(corpus: DataFrame, pattern: str, dotall: bool = False, **options) -> DataFrame:
    """(path, line_no, line): every line that a spanning match covers.

    A match's lines follow from the line feeds before and in it, so no offsets
    are joined: pieces between matches alternate with the matches, and one pass
    over them counts the feeds. A row takes with it its own line alone.
    """
    java = regex.java(pattern, dotall=dotall, **options)
    feeds = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))
    c = corpus.where(F.col("content").rlike(java))
    found = F.regexp_extract_all("content", F.lit(java), F.lit(0))
    between = F.slice(F.split("content", java, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("all"))

    def add(acc: Column, pair: Column) -> Column:
        low = acc["at"] + feeds(pair["b"])
        span = F.struct((low + 1).cast("int").alias("a"), (low + 1 + feeds(F.regexp_replace(pair["f"], "(?s)\n\\z", ""))).cast("int").alias("b"))
        return F.struct((low + feeds(pair["f"])).cast("int").alias("at"), F.concat(acc["all"], F.array(span)).alias("all"))

    spans = F.aggregate(F.arrays_zip(between.alias("b"), found.alias("f")), start, add, lambda acc: acc["all"])
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"]))))
    body = split_lines(F.col("content"))
    held = c.select("path", covered.alias("covered"), body.alias("body"))
    own = F.transform("covered", lambda n: F.struct(n.cast("long").alias("line_no"), F.get("body", n - 1).alias("line")))
    return held.select("path", F.inline(own)).where("line is not null")
