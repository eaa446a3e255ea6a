"""Units and whole searches over small corpora."""

import gzip
import json
import os
import random
import re

import pytest

from seine.functions import paths as P
from seine.operators import index as I
from seine.operators import lines as L
from seine.operators import modes as M
from seine.operators import search
from seine.operators.search import run
from seine.plans import regex as R
from seine.sources import tree
from seine.spec import UsageError, from_tool_request, parse_argv

FILES = {
    "src/main.rs": "use std::io;\nfn main() {\n    print(hello);\n}\n",
    "src/deep/util.rs": "pub fn helper() -> u32 {\n    42 // the answer\n}\n",
    "README.md": "# demo\nhello and goodbye\nfoo bar baz\n",
    "words.txt": "aaafooaaa\nfoo bar\nxfooy\nfoo\n",
    "case.txt": "foo\nFOO\nFoo\n",
    "gap.txt": "foo\nx1\nx2\nx3\nx4\nfoo\n",
    "mm.txt": "aa bb aa\nplain\n",
    "crlf.txt": "crlf hello\r\nsecond line\r\nhello end\r\n",
    ".hidden.txt": "hello hiddentoken\n",
    "nul.bin": "hello\x00x\n",
    "kelvin.txt": "Kelvin kfree\n",
    "empty.txt": "",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(p, c, k, len(c.encode())) for k, (p, c) in enumerate(FILES.items())], "path string, content string, mtime long, size long").cache()


def out(corpus, *argv):
    return run(corpus, parse_argv(list(argv))).lines()


def test_searches(corpus):
    assert out(corpus, "hello") == ["README.md:2:hello and goodbye", "crlf.txt:1:crlf hello\r", "crlf.txt:3:hello end\r", "src/main.rs:3:    print(hello);"]
    assert out(corpus, "-w", "foo", "words.txt") == ["2:foo bar", "4:foo"]
    assert out(corpus, "-xF", "foo", "words.txt", "-N") == ["foo"]
    assert out(corpus, "-i", "foo", "-c") == ["README.md:1", "case.txt:3", "gap.txt:2", "words.txt:4"]
    assert out(corpus, "-S", "Foo", "-l") == ["case.txt"]
    assert out(corpus, "-v", "foo", "words.txt") == []
    assert out(corpus, "foo", "gap.txt", "-C1") == ["1:foo", "2-x1", "--", "5-x4", "6:foo"]
    assert out(corpus, "-m1", "-A1", "foo", "gap.txt") == ["1:foo", "2-x1"]
    assert out(corpus, "-o", "-N", "aa", "mm.txt") == ["aa", "aa"]
    assert out(corpus, "--vimgrep", "aa", "mm.txt") == ["mm.txt:1:1:aa bb aa", "mm.txt:1:7:aa bb aa"]
    assert out(corpus, "-b", "--column", "answer") == ["src/deep/util.rs:2:15:25:    42 // the answer"]
    assert out(corpus, "-r", "<$0>", "a(.)", "mm.txt") == ["1:<aa> bb <aa>", "2:pl<ai>n"]
    assert out(corpus, "--count-matches", "aa") == ["mm.txt:2", "words.txt:2"]
    assert out(corpus, "-U", r"goodbye\nfoo") == ["README.md:2:hello and goodbye", "README.md:3:foo bar baz"]
    assert out(corpus, "--crlf", "hello$") == ["crlf.txt:1:crlf hello"]
    assert out(corpus, "--hidden", "hiddentoken", "-l") == [".hidden.txt"] and out(corpus, "hiddentoken") == []
    assert out(corpus, "-a", "hello", "nul.bin", "-c") == ["1"]
    assert out(corpus, "-i", "kelvin") == ["kelvin.txt:1:Kelvin kfree"]
    assert out(corpus, "--trim", "-M", "12", "fn") == ["src/deep/util.rs:1:[Omitted long matching line]", "src/main.rs:2:fn main() {"]
    assert out(corpus, "--passthru", "bb", "mm.txt") == ["1:aa bb aa", "2-plain"]
    assert out(corpus, "--heading", "helper") == ["src/deep/util.rs", "1:pub fn helper() -> u32 {"]
    assert out(corpus, "--files", "*.rs") == ["src/deep/util.rs", "src/main.rs"]
    assert out(corpus, "-g", "!src/deep", "-t", "rust", "fn", "-l") == ["src/main.rs"]
    assert out(corpus, "-l", "fn", "src/deep", "src") == ["src/deep/util.rs", "src/deep/util.rs", "src/main.rs"]
    assert out(corpus, "--sortr", "modified", "foo", "-l") == ["gap.txt", "case.txt", "words.txt", "README.md"]
    assert "empty.txt" in out(corpus, "--files-without-match", "foo")
    assert out(corpus, "-e", "baz", "-e", "x4") == ["README.md:3:foo bar baz", "gap.txt:5:x4"]
    events = [json.loads(x) for x in out(corpus, "--json", "-A1", "foo b", "words.txt")]
    assert [e["type"] for e in events] == ["begin", "match", "context", "end", "summary"]
    assert events[1]["data"]["submatches"] == [{"match": {"text": "foo b"}, "start": 0, "end": 5}] and events[1]["data"]["absolute_offset"] == 10
    assert events[2]["data"]["lines"]["text"] == "xfooy\n" and events[2]["data"]["submatches"] == []
    assert events[4]["data"]["stats"]["matched_lines"] == 1 and events[3]["data"]["binary_offset"] is None
    assert run(corpus, parse_argv(["nothing"])).exit_code() == 1 and run(corpus, parse_argv(["foo"])).exit_code() == 0
    with pytest.raises(R.RegexError):
        run(corpus, parse_argv(["a(?=b)"]))
    assert out(corpus, "-P", "f(?=oo b)", "-l") == ["README.md", "words.txt"]
    assert out(corpus, "-P", r"(.)\1 bb", "-l") == ["mm.txt"]


def test_empty_matches(spark):
    c = spark.createDataFrame([("x", "abc\nxyz\n")], "path string, content string")
    n = lambda p: [r.n for r in M.count_matches(L.lines(c), p).collect()]
    assert n("x*") == [7]
    assert n("b") == [1] and n("^") == [2]


def test_argv():
    assert parse_argv(["-u", "x"]).ignore == frozenset() and parse_argv(["--no-ignore-vcs", "x"]).ignore == {"dot", "parent"}
    assert parse_argv(["--no-ignore", "--ignore-dot", "x"]).ignore == {"dot"} and parse_argv(["-uuu", "--no-hidden", "x"]).hidden is False
    assert parse_argv(["--engine=auto", "a(?=b)"]).pcre and not parse_argv(["--engine", "auto", "ab"]).pcre
    assert parse_argv(["-a", "--binary", "x"]).binary == "convert" and parse_argv(["-U", "--stop-on-nonmatch", "x"]).multiline is False
    assert parse_argv(["--max-filesize=2K", "--context-separator", r"\x41\t", "x"]).group_separator == "A\t"
    s = parse_argv(["-iS", "-s", "-A2", "--context=1", "-uu", "foo", "a/", "./b"])
    assert (s.case, s.after, s.before, s.hidden, s.patterns, s.operands) == ("sensitive", 2, 1, True, ("foo",), ("a", "b"))
    assert parse_argv(["-l", "-c", "x"]).mode == "count" and parse_argv(["-co", "x"]).mode == "count_matches"
    assert parse_argv(["--", "-x"]).patterns == ("-x",)
    for bad in (["--sort", "bogus", "x"], ["--engine", "x", "y"], ["--max-filesize", "3X", "y"], ["-E", "no-such", "y"], ["--max-columns-preview", "x"], ["--nope", "x"], ["-A", "q", "x"], [], ["-e"]):
        with pytest.raises(UsageError):
            parse_argv(bad)
    t = from_tool_request({"pattern": "x", "output_mode": "content", "-i": True, "-C": 2, "head_limit": 3, "glob": "*.py"})
    assert (t.mode, t.case, t.before, t.after, t.limit, t.globs) == ("lines", "ignore", 2, 2, 3, ("*.py",))


def tris(pattern, **o):
    p = R.plan(pattern, **o)
    return p if p is None else [{R.unpack(s[0]).decode() for s in g} for g in p]


def test_plans():
    assert tris("hello", fixed=True) == [{"hel", "ell", "llo"}]
    assert sorted(map(sorted, tris("foobar|bazqux"))) == [["azq", "baz", "qux", "zqu"], ["bar", "foo", "oba", "oob"]]
    for p in ("(?x)foo bar", "(?x: a b c ) d", "(?ix)FOO # no literal"):
        assert tris(p) is None, p
    for p in (".*", "a", "x?yz", "(foo|.*)bar?", "[0-9][0-9]", "a|bcd"):
        assert tris(p) is None, p
    assert tris("needle.*") == [{"nee", "eed", "edl", "dle"}] and tris(r"abc\w+def") == [{"abc", "def"}]
    assert sorted(map(sorted, tris("xa[bc]d"))) == [["abd", "xab"], ["acd", "xac"]]
    assert len(tris("ab[a-z0-9]")) == 36 and len(R.plan("kfr", ignore_case=True)[0][0]) == 9
    assert "bab" in tris("x(ab){2}y")[0] and tris("(?:a.){300}") is None
    with pytest.raises(R.RegexError):
        R.plan("[")
    assert len(R.spellings(int.from_bytes(b"a1b", "big"))) == 4 and R.plan("kss", ignore_case=True) is not None
    # Every spelling that folds alike has a variant of every trigram.
    for text in ("Kiss", "kIs\u017f", "\u212aISS", "ki\u017f\u017f"):
        have = R.trigrams(text.encode())
        assert all(any(s in have for s in t) for t in R.plan("kiss", ignore_case=True)[0]), text
    for text in ("naïveté", "NAÏVETÉ"):
        have = R.trigrams(text.encode())
        assert all(any(s in have for s in t) for t in R.plan("Naïveté", ignore_case=True)[0]), text


def test_replacements():
    assert R.replacement("${1}x$2 $1x \\n$$", "(a)(b)") == "$1x$2  \\\\n\\$" and R.replacement("$1", "a") == "" and R.replacement("${1}0", "(a)") == "$1\\0"
    assert R.replacement("$n-${n}", "(?P<n>a)") == "${n}-${n}" and R.replacement("$0", "a", fixed=True) == "$0"


def test_plans_are_sound():
    rng = random.Random(7)
    atoms = ["abc", "bca", "a", "b", "[ab]c", "(?:ab|ca)b", "c+", "a?", ".", "(?i)abC", "(ab){2}", "(?:bc|abca)", r"\w", "^", "$", "a{2,3}", "(?x: a b c )", "(?i:bC)"]
    texts = ["".join(rng.choice("abcABC") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    for _ in range(400):
        p = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.3:
            p += "|" + rng.choice(atoms) + rng.choice(atoms)
        fold = rng.random() < 0.4
        groups = R.plan(p, ignore_case=fold)
        python = re.compile(re.sub(r"\(\?i\)", "", p), re.I if fold or "(?i)" in p else 0)
        literals = None if fold or "(?i" in p else R.required_literals(p)
        assert literals is None or all(any(x in t for x in literals) for t in texts if python.search(t)), p
        for t in texts if groups is not None else ():
            if python.search(t):
                have = R.trigrams(t.encode())
                assert any(all(any(s in have for s in spelled) for spelled in g) for g in groups), (p, t)


def test_ignore_rules(spark):
    names = ["a.log", "keep.log", "build/x.o", "src/build/y.o", "src/a.c", "doc/b.txt", "doc/sub/c.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = lambda *lines: sorted(r.path for r in df.where(P.ignored(df.path, [P.Rule.parse(x) for x in lines])).collect())
    assert got("*.log", "!keep.log") == ["a.log"]
    assert got("build/") == ["build/x.o", "src/build/y.o"] and got("/build") == ["build/x.o"]
    assert got("doc/*.txt") == ["doc/b.txt"] and got("doc/**") == ["doc/b.txt", "doc/sub/c.txt"]
    assert P.Rule.parse("# no") is None and P.Rule.parse("") is None


def test_index_lifecycle(spark, corpus, tmp_path):
    index = I.Index(spark, str(tmp_path / "x")).build(corpus)
    for argv in (["foo"], ["helper|goodbye"], ["-i", "FOO"], ["a.b"], ["-v", "foo"], ["-F", "fn main"], ["nosuchthing"]):
        spec = parse_argv(argv)
        assert run(corpus, spec, index=index).lines() == run(corpus, spec).lines(), argv
    assert sorted(r.path for r in index.candidates(R.plan("goodbye")).collect()) == ["README.md"]
    changed = [("words.txt", "goodbye\n", 99, 8), ("new.txt", "goodbye\n", 1, 8)] + [(p, c, k, len(c.encode())) for k, (p, c) in enumerate(FILES.items()) if p not in ("words.txt", "README.md")]
    now = spark.createDataFrame(changed, corpus.schema)
    status = {r.path: r.status for r in I.freshness(now, index.manifest()).collect()}
    assert (status["words.txt"], status["new.txt"], status["README.md"], status["case.txt"]) == ("changed", "new", "dead", "same")
    index.open(corpus, ttl=3600)
    assert "new.txt" not in {r.path for r in index.manifest().collect()}
    index.open(now)
    assert {r.path for r in index.candidates(R.plan("goodbye")).collect()} == {"words.txt", "new.txt"}
    assert index.status().first().files == len(changed) == index.manifest().select("file_id").distinct().count()
    one = I.Index(spark, str(tmp_path / "y")).build(now.limit(1))
    assert one.meta()["next_id"] == 1
    assert index.has_files_under("src") and not index.has_files_under("nowhere") and [r.path for r in index.binary_files().collect()] == ["nul.bin"]
    # A writer at work: others answer from the index and from what is new, and write nothing.
    with index.lock():
        with pytest.raises(I.Busy):
            I.Index(spark, index.path).update(now)
        later = now.where("path <> 'gap.txt'").union(spark.createDataFrame([("later.txt", "goodbye foo\n", 3, 12)], corpus.schema))
        other = I.Index(spark, index.path).open(later)
        assert {r.path for r in other.candidates(R.plan("goodbye")).collect()} == {"words.txt", "new.txt", "later.txt"}
        assert "gap.txt" not in {r.path for r in other.candidates(R.plan("foo")).collect()}
        none = I.Index(spark, str(tmp_path / "z"))
        with none.lock():
            assert I.Index(spark, none.path).open(now).no_index
            assert run(now, parse_argv(["goodbye", "-l"]), index=I.Index(spark, none.path).open(now)).lines() == run(now, parse_argv(["goodbye", "-l"])).lines()
    assert not (tmp_path / "x" / "lock").exists()
    beside = one.open_later(now), I.Index(spark, str(tmp_path / "w"))
    thread = beside[1].open_later(now, least_bytes=1)
    assert beside[0] is None and beside[1].no_index
    thread.join()
    assert I.Index(spark, beside[1].path).open(now).status().first().files == len(changed)


def test_index_equals_scan(spark, corpus, tmp_path):
    """Searches of many kinds give the same records with the index and without."""
    index = I.Index(spark, str(tmp_path / "x")).build(corpus)
    for argv in (["(?x)foo \\  b"], ["(?x) f o o #c"], ["-i", "KELVIN"], ["-e", "fo{2}", "-e", "h[ae]l+o", "-c"], ["-F", "foo b", "-F", "-e", "main("], ["-w", "foo", "-l"], ["-U", "(?s)goodbye.*bar", "-l"], ["-P", "f(?=oo b)", "-c"]):
        spec = parse_argv(argv)
        narrowed = R.plan(spec.patterns[0], spec.fixed, spec.ignore_case, spec.unicode, spec.pcre) is not None
        assert run(corpus, spec, index=index).lines() == run(corpus, spec).lines(), (argv, narrowed)
    few, search.FEW = search.FEW, 1
    try:
        assert run(corpus, parse_argv(["-c", "foo"]), index=index).lines() == run(corpus, parse_argv(["-c", "foo"])).lines()
    finally:
        search.FEW = few


def test_tree(spark, tmp_path):
    for name, text in {".gitignore": "*.log\n!.keep\n", "a.log": "hello\n", "b.txt": "hello\n", ".keep": "hello\n", ".hid/x.txt": "hello\n", "sub/.ignore": "/only.txt\n", "sub/only.txt": "", "sub/deep/only.txt": "hello\n", ".git/config": "hello\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"zipneedle\n"))
    (tmp_path / "u16.txt").write_bytes(b"\xff\xfe" + "wide hello\n".encode("utf-16-le"))
    root = str(tmp_path)
    files = tree.sweep(spark, root)
    assert {r.path: r.hidden for r in files.collect()} == {".gitignore": True, ".keep": False, "b.txt": False, ".hid/x.txt": True, "p.gz": False, "u16.txt": False, "sub/.ignore": True, "sub/deep/only.txt": False}
    assert {r.path for r in tree.sweep(spark, root, hidden=False).collect()} == {".keep", "b.txt", "p.gz", "u16.txt", "sub/deep/only.txt"}
    assert {r.path for r in tree.sweep(spark, root, ["sub"], ignore=False, hidden=False).collect()} == {"sub/only.txt", "sub/deep/only.txt"}
    text = {r.path: r.content for r in tree.with_content(files, root, unzip=True).collect()}
    assert text["p.gz"] == "zipneedle\n" and text["u16.txt"] == "wide hello\n" and text["b.txt"] == "hello\n"
    upper = tree.with_content(files.where("path = 'b.txt'"), root, pre=["sh", "-c", "tr a-z A-Z"])
    assert [r.content for r in upper.collect()] == ["HELLO\n"] and os.path.exists(root)


def test_streaming(spark, tmp_path):
    from seine.streaming.ingest import ingest

    index, inbox = I.Index(spark, str(tmp_path / "i")), str(tmp_path / "in")
    schema = "path string, content string, mtime long, size long"
    for k, rows in enumerate(([("a", "first needle", 1, 12)], [("b", "second needle", 1, 13), ("a", "changed", 2, 7)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        ingest(spark.readStream.schema(schema).parquet(inbox), index, str(tmp_path / "c")).awaitTermination()
    assert {r.path for r in index.candidates(R.plan("needle")).collect()} == {"b"}
    assert {r.path for r in index.manifest().collect()} == {"a", "b"}
    # Of a path that comes twice in a batch, the later row counts.
    spark.createDataFrame([("c", "needle old", 1, 10), ("c", "new", 5, 3), ("c", "needle older", 0, 12)], schema).coalesce(1).write.mode("append").parquet(inbox)
    ingest(spark.readStream.schema(schema).parquet(inbox), index, str(tmp_path / "c")).awaitTermination()
    assert {r.path: r.mtime for r in index.manifest().collect()}["c"] == 5


def test_trigram_df_of_all_documents(spark):
    from collections import Counter

    from seine.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()]
    assert not all(map(bytes.isascii, texts))
    want = Counter(x for t in texts for x in {int.from_bytes(t[i : i + 3], "big") for i in range(len(t) - 2)})
    assert {r.tri: r.df for r in QUERIES["trigram_df"](spark, sf).collect()} == want


def test_sql(spark, corpus):
    from seine import sql

    sql.register(corpus, prefix="t_")
    rows = spark.sql("select g.path, f.size from t_grep('^fo+$') g join t_files f on f.path = g.path where g.line_no > 1").collect()
    assert sorted(map(tuple, rows)) == [("gap.txt", len(FILES["gap.txt"])), ("words.txt", len(FILES["words.txt"]))]
    assert spark.sql("select count(*) from t_lines where path = 'case.txt'").first()[0] == 3
