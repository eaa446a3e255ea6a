"""Queries of the search engine and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.functions import paths as P
from seine.operators import index as I
from seine.operators import lines as L
from seine.operators import modes as M
from seine.operators.order import ranked
from seine.plans import regex as R
from seine import products
from seine.sources import corpora

QUERIES: dict = dict(products.QUERIES)
ORACLES: dict = dict(products.ORACLES)

_CTE = (
    f"with d as (select *, {corpora.PATH} as path, 1700000000 + doc_id * 37 % 1000 as mtime, octet_length(encode(text)) as size from documents where text is not null),"
    " a as (select path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as parts from d where text <> ''),"
    " l as (select path, unnest(parts) as line, generate_subscripts(parts, 1) as line_no from a) "
)
_OFF = "(coalesce(sum(octet_length(encode(line)) + 1) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0))"


def _add(name: str, run, sql: str | None = None, cte: bool = True) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = (_CTE if cte else "") + sql


def _c(spark, sf) -> DataFrame:
    return corpora.documents(spark, sf)


def _l(spark, sf) -> DataFrame:
    return L.lines(_c(spark, sf))


def _hits(name: str, pattern: str, where: str, invert: bool = False, **options) -> None:
    _add(name, lambda s, d: L.marked(_l(s, d), pattern, invert, **options).where("is_match").drop("is_match"), f"select path, line_no, line from l where {where}")


_hits("regex_match", "tion", "regexp_matches(line, 'tion')")
_hits("fixed_string", "the.", "contains(line, 'the.')", fixed=True)
_hits("ignore_case", "THE [a-c]", "regexp_matches(line, '(?i)the [a-c]')", ignore_case=True)
_hits("smart_case", "license", "regexp_matches(line, '(?i)license')", ignore_case=R.smart_case("license"))
_hits("word_regexp", "that", "regexp_matches(line, '(^|[^0-9A-Za-z_À-ÿŒœ])that($|[^0-9A-Za-z_À-ÿŒœ])')", word=True)
_hits("line_regexp", "[A-Z][a-z]+ [a-z]+[.]", "regexp_matches(line, '^[A-Z][a-z]+ [a-z]+[.]$')", line=True)
_hits("invert_match", "the", "not regexp_matches(line, 'the')", invert=True)
_hits("no_unicode", r"\d{4}", "regexp_matches(line, '[0-9]{4}')", unicode=False)
_hits("patterns_union", L.alternation(["License", "nterti", "a.b"], fixed=True), "contains(line, 'License') or contains(line, 'nterti') or contains(line, 'a.b')")
_hits("pcre_lookahead", "the(?=re)", "contains(line, 'there')")
_hits("pcre_backref", r"(th)\1", "contains(line, 'thth')")
_hits("line_numbers", "^Th", "regexp_matches(line, '^Th')")

_add("scan_lines", lambda s, d: _l(s, d), "select path, line_no, line from l")


def _context(before: int, after: int):
    return lambda s, d: L.context(L.marked(L.lines(L.holding(_c(s, d), "nterti")), "nterti"), before, after)


_CTX = "select path, line_no, line, is_match from (select *, contains(line, 'nterti') as is_match, max(contains(line, 'nterti')::int) over (partition by path order by line_no rows between {a} preceding and {b} following) as near from l) where near = 1"
for _name, _b, _a in (("context", 1, 2), ("before_context", 2, 0), ("after_context", 0, 3)):
    _add(_name, _context(_b, _a), _CTX.format(a=_a, b=_b))
_add(
    "context_groups",
    lambda s, d: L.grouped(_context(1, 1)(s, d)).select("path", "line_no", F.col("grp").cast("long").alias("grp")),
    "select path, line_no, cast(sum(case when gap > 1 or gap is null then 1 else 0 end) over (partition by path order by line_no) as bigint) as grp from (select *, line_no - lag(line_no) over (partition by path order by line_no) as gap from (" + _CTX.format(a=1, b=1) + "))",
)
_add("max_count", lambda s, d: L.max_count(L.marked(L.lines(L.holding(_c(s, d), "tion")), "tion"), 2).where("is_match").select("path", "line_no", "line"), "select path, line_no, line from (select *, row_number() over (partition by path order by line_no) as n from l where contains(line, 'tion')) where n <= 2")
_add(
    "stop_on_nonmatch",
    lambda s, d: L.stop_on_nonmatch(L.marked(_l(s, d), "tion")).where("is_match").select("path", "line_no"),
    "select path, line_no from (select *, max((seen = 1 and not m)::int) over (partition by path order by line_no) as stop from (select *, contains(line, 'tion') as m, max(contains(line, 'tion')::int) over (partition by path order by line_no) as seen from l)) where m and stop = 0",
)
_add("passthru", lambda s, d: L.marked(_l(s, d), "tion"), "select path, line_no, line, contains(line, 'tion') as is_match from l")
_add("only_matching", lambda s, d: L.occurrences(_l(s, d), "[a-z]+tion").select("path", "line_no", "match"), "select path, line_no, unnest(regexp_extract_all(line, '[a-z]+tion')) as match from l")
_add("column", lambda s, d: L.marked(_l(s, d), "tion").where("is_match").select("path", "line_no", L.column("tion").alias("col")), "select path, line_no, cast(octet_length(encode(substr(line, 1, strpos(line, 'tion') - 1))) + 1 as int) as col from l where contains(line, 'tion')")
_add("byte_offset", lambda s, d: L.with_offsets(L.marked(_l(s, d), "tion")).where("is_match").select("path", "line_no", "byte_offset"), f"select path, line_no, byte_offset from (select *, cast({_OFF} as bigint) as byte_offset from l) where contains(line, 'tion')")
_add(
    "vimgrep",
    lambda s, d: L.vimgrep(_l(s, d), "nt").select("path", "line_no", F.col("col").cast("int").alias("col")),
    "select path, line_no, cast(octet_length(encode(array_to_string(p[1:k], 'nt'))) + 1 as int) as col from (select path, line_no, string_split(line, 'nt') as p, unnest(range(1, len(string_split(line, 'nt')))) as k from l where contains(line, 'nt'))",
)
_add("max_columns", lambda s, d: L.marked(_l(s, d), "tion").where("is_match").select("path", "line_no", L.limited(200).alias("line")), "select path, line_no, case when octet_length(encode(line)) > 200 then '[Omitted long matching line]' else line end as line from l where contains(line, 'tion')")
_add("trim", lambda s, d: _l(s, d).withColumn("line", F.concat(F.lit(" \t"), "line")).select("path", "line_no", L.trimmed().alias("line")), r"select path, line_no, regexp_replace(line, '^[ \t\r\n\f\v]+', '') as line from l")
_add("replace", lambda s, d: L.marked(_l(s, d), "tion").where("is_match").select("path", "line_no", L.replaced("tion", "SHUN").alias("line")), "select path, line_no, regexp_replace(line, 'tion', 'SHUN', 'g') as line from l where contains(line, 'tion')")
_add("replace_groups", lambda s, d: L.marked(_l(s, d), "(t)(ion)").where("is_match").select("path", "line_no", L.replaced("(t)(ion)", "$2-$1").alias("line")), r"select path, line_no, regexp_replace(line, '(t)(ion)', '\2-\1', 'g') as line from l where contains(line, 'tion')")
_add("multiline", lambda s, d: L.multiline(_c(s, d), r"[a-z]+\.\n[A-Z]").select("path", "match"), r"select path, unnest(regexp_extract_all(text, '[a-z]+\.\n[A-Z]')) as match from d")
_add(
    "heading",
    lambda s, d: (lambda m: m.select("path", F.lit(0).alias("line_no"), F.col("path").alias("out")).distinct().union(m.select("path", "line_no", F.concat_ws(":", F.col("line_no").cast("string"), "line"))))(L.marked(_l(s, d), "nterti").where("is_match")),
    "select distinct path, 0 as line_no, path as out from l where contains(line, 'nterti') union all select path, line_no, concat_ws(':', cast(line_no as varchar), line) from l where contains(line, 'nterti')",
)

_add("count_lines", lambda s, d: M.count_lines(L.marked(_l(s, d), "tion")), "select path, count(*) as n from l where contains(line, 'tion') group by path")
_add("count_matches", lambda s, d: M.count_matches(_l(s, d), "t[hi]"), "select path, cast(sum(len(regexp_extract_all(line, 't[hi]'))) as bigint) as n from l where regexp_matches(line, 't[hi]') group by path")
_add("count_include_zero", lambda s, d: M.count_lines(L.marked(_l(s, d), "nterti"), _c(s, d)), "select d.path, coalesce(n, 0) as n from d left join (select path, count(*) as n from l where contains(line, 'nterti') group by path) x on d.path = x.path")
_add("files_with_matches", lambda s, d: M.files_with(_c(s, d), "License"), "select path from d where contains(text, 'License')")
_add("files_without_match", lambda s, d: M.files_without(_c(s, d), "^The"), "select path from d where path not in (select path from l where regexp_matches(line, '^The'))")
_add("quiet_exists", lambda s, d: M.exists(_c(s, d), "nterti"), "select count(*) > 0 as found from l where contains(line, 'nterti')")
_add(
    "stats",
    lambda s, d: M.stats(_c(s, d), L.marked(_l(s, d), "tion"), "tion"),
    "select cast((select sum(len(regexp_extract_all(line, 'tion'))) from l) as bigint) as matches, (select count(*) from l where contains(line, 'tion')) as matched_lines, (select count(distinct path) from l where contains(line, 'tion')) as searches_with_match, (select count(*) from d) as searches, cast((select sum(size) from d) as bigint) as bytes_searched",
)
_add(
    "json_match_events",
    lambda s, d: M.json_events(L.marked(_l(s, d), "nterti"), "nterti").select("path", F.get_json_object("event", "$.type").alias("type"), F.get_json_object("event", "$.data.line_number").cast("long").alias("line_no"), F.get_json_object("event", "$.data.absolute_offset").cast("long").alias("absolute_offset")),
    f"select path, 'match' as type, cast(line_no as bigint) as line_no, absolute_offset from (select *, cast({_OFF} as bigint) as absolute_offset from l) where contains(line, 'nterti') union all select distinct path, t, null, null from l, (values ('begin'), ('end')) v(t) where contains(line, 'nterti')",
)

_files = lambda cond: lambda s, d: _c(s, d).where(cond(F.col("path"))).select("path")
for _name, _cond, _sql in (
    ("files_all", lambda p: ~P.excluded(p), "true"),
    ("files_glob", lambda p: P.matches(p, "*.rs"), "path like '%.rs'"),
    ("glob_include", lambda p: P.overridden(p, ["*.{md,py}"]), "path like '%.md' or path like '%.py'"),
    ("glob_negate", lambda p: P.overridden(p, ["!de"]), "path not like 'de/%'"),
    ("glob_last_wins", lambda p: P.overridden(p, ["*.md", "!en/**/*.md", "en/src1/*.md"]), "path like '%.md' and (path not like 'en/%' or regexp_matches(path, '^en/src1/[^/]*[.]md$'))"),
    ("iglob", lambda p: P.overridden(p, ["*.TXT"], ignore_case=True), "path like '%.txt'"),
    ("type_select", lambda p: P.typed(p, ["rust", "py"], []), "path like '%.rs' or path like '%.py'"),
    ("type_not", lambda p: P.typed(p, [], ["markdown"]), "path not like '%.md'"),
    ("ignore_file", lambda p: ~P.ignored(p, [P.Rule.parse(x) for x in ("*.py", "!src3/*.py", "/fr/")]), "not (path like 'fr/%' or path like '%.py')"),
    ("gitignore_filter", lambda p: ~P.ignored(p, [P.Rule.parse(x) for x in ("*.py", "!*7.py", "src2/")]), "path not like '%/src2/%' and (path not like '%.py' or path like '%7.py')"),
    ("hidden_default", lambda p: ~P.hidden(p), "not contains(path, '/.')"),
    ("hidden_shown", P.hidden, "contains(path, '/.')"),
    ("max_depth", lambda p: P.depth(p) <= 3, "len(string_split(path, '/')) <= 3"),
):
    _add(_name, _files(_cond), f"select path from d where {_sql}")
_add("path_operands", lambda s, d: P.operands(_c(s, d), ["fr", "en/src1", "fr/src2"]).select("operand", "path"), "select 0 as operand, path from d where starts_with(path, 'fr/') union all select 1, path from d where starts_with(path, 'en/src1/') union all select 2, path from d where starts_with(path, 'fr/src2/')")

for _name, _order, _sql in (
    ("sort_path", lambda: [P.order_key(F.col("path"))], "string_split(path, '/')"),
    ("sortr_path", lambda: [P.order_key(F.col("path")).desc()], "string_split(path, '/') desc"),
    ("sort_modified", lambda: [F.col("mtime"), P.order_key(F.col("path"))], "mtime, string_split(path, '/')"),
):
    _add(_name, lambda s, d, o=_order: ranked(_c(s, d).select("path", "mtime"), *o()).select("path", "rank"), f"select path, row_number() over (order by {_sql}) as rank from d")
_add("limit_offset", lambda s, d: _l(s, d).where(F.col("line").contains("tion")).orderBy("path", "line_no").offset(20).limit(50).select("path", "line_no"), "select path, line_no from l where contains(line, 'tion') order by path, line_no limit 50 offset 20")


def _post(spark, sf, wanted=None) -> DataFrame:
    return I.postings(_c(spark, sf).withColumn("file_id", F.col("doc_id")), wanted)


def _narrowed(pattern: str, **options):
    """Documents narrowed by a plan, straight from the contents' trigrams that it asks for."""
    plan = R.plan(pattern, **options)
    return lambda s, d: I.narrowed(_post(s, d, sorted({x for g in plan for t in g for x in t})), plan)


def _tri(text: str) -> int:
    return int.from_bytes(text.encode(), "big")


#: Byte trigrams, in SQL by way of hexadecimal digits.
_add(
    "trigram_df",
    lambda s, d: _post(s, d).groupBy("tri").agg(F.count("*").alias("df")),
    "select tri, count(*) as df from (select distinct doc_id, cast('0x' || substr(h, 2 * i - 1, 6) as int) as tri"
    " from (select doc_id, h, unnest(generate_series(1, len(h) // 2 - 2)) as i from (select doc_id, hex(encode(text)) as h from d))) group by tri",
)
_add("and_candidates", _narrowed("tion"), "select doc_id as file_id from d where contains(text, 'tio') and contains(text, 'ion')")
_add("or_candidates", _narrowed("nterti|Lice"), "select doc_id as file_id from d where (contains(text, 'nte') and contains(text, 'ter') and contains(text, 'ert') and contains(text, 'rti')) or (contains(text, 'Lic') and contains(text, 'ice'))")
_add("icase_candidates", _narrowed("the a", ignore_case=True), "select doc_id as file_id from d where regexp_matches(text, '(?i)the') and regexp_matches(text, '(?i)he ') and regexp_matches(text, '(?i)e a')")
_add("binary_text", lambda s, d: L.marked(L.lines(_c(s, d).withColumn("content", F.concat(F.lit("\x00"), "content"))), "tion").where("is_match").select("path", "line_no"), "select path, line_no from l where contains(line, 'tion')")


def _snapshots(s, d):
    c = _c(s, d)
    old = c.select("path", F.col("doc_id").alias("file_id"), "mtime", "size").where("file_id % 11 <> 0")
    return c.where("doc_id % 7 <> 0").withColumn("mtime", F.col("mtime") + (F.col("doc_id") % 5 == 0).cast("long")), old


_add("freshness_diff", lambda s, d: I.freshness(*_snapshots(s, d)).select("path", "status"), "select path, case when doc_id % 11 = 0 then 'new' when doc_id % 7 = 0 then 'dead' when doc_id % 5 = 0 then 'changed' else 'same' end as status from d where not (doc_id % 11 = 0 and doc_id % 7 = 0)")
_add("live_after_update", lambda s, d: (lambda x: x[1].join(I.freshness(*x).where("status in ('changed', 'dead')"), "file_id", "left_anti").select("path"))(_snapshots(s, d)), "select path from d where doc_id % 11 <> 0 and doc_id % 7 <> 0 and doc_id % 5 <> 0")
