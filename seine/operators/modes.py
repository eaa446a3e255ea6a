"""Output modes over marked lines: counts, file lists, statistics, JSON events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.operators import lines as L

_LAST = 2**62


def _elapsed() -> Column:
    """Times are no part of a result: events have them as nothing."""
    return F.struct(F.lit(0).alias("secs"), F.lit(0).alias("nanos"), F.lit("0.000000s").alias("human"))


def count_lines(m: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, n) of files with a match, or, given all ``files``, zeros too."""
    n = m.where("is_match").groupBy("path").agg(F.count("*").alias("n"))
    return n if files is None else files.select("path").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def count_matches(rows: DataFrame, pattern: str, **options) -> DataFrame:
    """(path, n) occurrences."""
    hit = rows.where(L.matching(F.col("line"), pattern, **options))
    return hit.groupBy("path").agg(F.sum(L.count_column(pattern, **options)).alias("n")).where("n > 0")


def files_with(corpus: DataFrame, pattern: str, terminator: str = "lf", **options) -> DataFrame:
    """(path): whole contents are tested once; lines are never formed as rows."""
    return L.holding(corpus, pattern, **options).where(anywhere(pattern, terminator, **options)).select("path")


def files_without(corpus: DataFrame, pattern: str, terminator: str = "lf", **options) -> DataFrame:
    return corpus.where(~anywhere(pattern, terminator, **options)).select("path")


def anywhere(pattern: str, terminator: str = "lf", **options) -> Column:
    """Line-wise match of a whole content: ^ and $ are line anchors, and classes must not span lines."""
    if L.plain(options):
        return F.col("content").contains(pattern)
    body = L.split_lines(F.col("content"), terminator)
    return (F.col("content") != "") & F.exists(body, lambda x: L.matching(x, pattern, **options))


def exists(corpus: DataFrame, pattern: str, terminator: str = "lf", **options) -> DataFrame:
    """One row: whether anything matches; stops at the first."""
    one = files_with(corpus, pattern, terminator, **options).limit(1)
    return one.agg((F.count("*") > 0).alias("found"))


def stats(corpus: DataFrame, m: DataFrame, pattern: str, **options) -> DataFrame:
    """One row of the counters of a run."""
    hit = m.where("is_match")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    a = hit.agg(
        zero(F.sum(L.count_column(pattern, **options))).alias("matches"),
        F.count("*").alias("matched_lines"),
        F.count_distinct("path").alias("searches_with_match"),
    )
    b = corpus.agg(F.count("*").alias("searches"), zero(F.sum(F.octet_length("content"))).alias("bytes_searched"))
    return a.crossJoin(b)  # one row each


def _text(c: Column) -> Column:
    return F.struct(c.alias("text"))


def json_events(m: DataFrame, pattern: str, replacement: str | None = None, before: int = 0, after: int = 0, **options) -> DataFrame:
    """(path, ord, event): begin, match, context and end events of every file with a match.

    ``m`` has all lines of a file, with ``eol`` where lines end otherwise than in a line feed.
    """
    rows = L.with_offsets(m)
    rows = L.context(rows, before, after) if before or after else rows.where("is_match")
    eol = F.col("eol") if "eol" in m.columns else F.lit("\n")
    found = L.pieces(pattern, **options)

    def submatch(x: Column) -> Column:
        more = [] if replacement is None else [_text(L.replaced(pattern, replacement, of=x["match"], **options)).alias("replacement")]
        return F.struct(_text(x["match"]).alias("match"), *more, x["start"].alias("start"), x["end"].alias("end"))

    sub = F.transform(found, submatch)
    none = F.slice(sub, F.lit(1), F.lit(0))
    data = F.struct(
        _text(F.col("path")).alias("path"),
        _text(F.concat("line", eol)).alias("lines"),
        F.col("line_no").alias("line_number"),
        F.col("byte_offset").alias("absolute_offset"),
        F.when(F.col("is_match"), sub).otherwise(none).alias("submatches"),
    )
    kind = F.when(F.col("is_match"), "match").otherwise("context").alias("type")
    shown = rows.select("path", F.col("line_no").cast("long").alias("ord"), F.to_json(F.struct(kind, data.alias("data"))).alias("event"))
    hit = rows.where("is_match")
    per = hit.groupBy("path").agg(F.count("*").alias("matched_lines"), F.sum(L.count_column(pattern, **options)).alias("matches"))
    begin = per.select("path", F.lit(0).cast("long").alias("ord"), F.to_json(F.struct(F.lit("begin").alias("type"), F.struct(_text(F.col("path")).alias("path")).alias("data"))).alias("event"))
    counts = F.struct(_elapsed().alias("elapsed"), F.lit(1).alias("searches"), F.lit(1).alias("searches_with_match"), "matched_lines", "matches")
    end = F.struct(F.lit("end").alias("type"), F.struct(_text(F.col("path")).alias("path"), F.lit(None).cast("long").alias("binary_offset"), counts.alias("stats")).alias("data"))
    return begin.union(shown).union(per.select("path", F.lit(_LAST).cast("long").alias("ord"), F.to_json(end, {"ignoreNullFields": "false"}).alias("event")))


def json_summary(counters: dict, seconds: float) -> dict:
    """The closing event of a JSON run."""
    elapsed = {"human": f"{seconds:.6f}s", "nanos": int(seconds % 1 * 1e9), "secs": int(seconds)}
    keys = ("bytes_printed", "bytes_searched", "matched_lines", "matches", "searches", "searches_with_match")
    return {"data": {"elapsed_total": elapsed, "stats": {"elapsed": elapsed, **{k: counters[k] for k in keys}}}, "type": "summary"}
