"""Command lines over a tree of files: records, order and exit status, with the index and without."""

import gzip

import pytest

from seine.operators import index as I
from seine.operators.search import run, search_tree
from seine.sources import tree
from seine.spec import SearchSpec, UsageError, parse_argv

FILES = {
    "src/main.rs": 'use std::io;\nfn main() {\n    println!("hello world");\n}\n',
    "src/deep/util.rs": "pub fn helper() -> u32 {\n    42 // the answer\n}\n",
    "README.md": "# demo\nhello and goodbye\nfoo bar baz\n",
    ".gitignore": "*.log\n",
    "skipme.log": "hello hidden\n",
    ".ignore": "skipme2.txt\n",
    "skipme2.txt": "hello hidden via dot-ignore\n",
    "adjacent.txt": "aXb\ncXd\naXb\ncXd\n",
    "words.txt": "aaafooaaa\nfoo bar\nxfooy\nfoo\n",
    "dots.txt": "foo.bar\nfooXbar\nafoo.bar\n",
    "case.txt": "foo\nFOO\nFoo\n",
    "ctx.txt": "ctx1\nmatch1\nctx2\nmatch2\nctx3\n",
    "gap.txt": "foo\nx1\nx2\nx3\nx4\nfoo\n",
    ".github/workflows/ci.yml": "hiddentoken: yes\n",
    ".hidden.txt": "hiddentoken in a file\n",
    "binnul.bin": "all\0binary hello\n",
    "binpre.bin": "a match here\nnul\0after\n",
    "dotkit/.gitignore": ".*\n!.gitignore\n!.keepme\n!.wdir/\n",
    "dotkit/.keepme": "keeptoken\n",
    "dotkit/.nope": "nopetoken\n",
    "dotkit/.wdir/in.txt": "wdirtoken\n",
    "dotkit/plain.txt": "plain words\n",
    "pad.txt": "    padded line\n\ttabbed\n",
    "mm.txt": "aa bb aa\nplain\n",
    "crlf.txt": "crlf hello\r\nsecond line\r\nhello end\r\n",
    "noext": "hello from a file without a dot\n",
    "late.txt": "early hit\n" + ("y" * 99 + "\n") * 800 + "nul\0here\nlate hit\n",
}
LATE = len(FILES["late.txt"].split("\0")[0])
HELLO = ["README.md:2:hello and goodbye", "crlf.txt:1:crlf hello\r", "crlf.txt:3:hello end\r", "noext:1:hello from a file without a dot", 'src/main.rs:3:    println!("hello world");']
CASES = [
    (["hello"], HELLO, 0),
    (["--crlf", "hello$"], ["crlf.txt:1:crlf hello"], 0),
    (["--crlf", "-l", "end$"], ["crlf.txt"], 0),
    (["--crlf", "-b", "end$"], ["crlf.txt:3:25:hello end"], 0),
    (["--crlf", "--files-without-match", "(hello|end)$", "crlf.txt", "mm.txt"], ["mm.txt"], 0),
    (["-l", "--null-data", "^binary hello\n$|^nope$", "binnul.bin"], ["binnul.bin"], 0),
    (["--null-data", "-c", "hello", "binnul.bin"], ["1"], 0),
    (["hello", "noext"], ["1:hello from a file without a dot"], 0),
    (["-c", "hello", "README.md"], ["1"], 0),
    (["-H", "hello", "README.md"], ["README.md:2:hello and goodbye"], 0),
    (["--vimgrep", "hello", "README.md"], ["README.md:2:1:hello and goodbye"], 0),
    (["--vimgrep", "-I", "aa", "mm.txt"], ["1:1:aa bb aa", "1:7:aa bb aa"], 0),
    (["-o", "-b", "aa", "mm.txt"], ["1:0:aa", "1:6:aa"], 0),
    (["-o", "--column", "a+", "mm.txt"], ["1:1:aa", "1:7:aa", "2:3:a"], 0),
    (["-o", "x*", "mm.txt"], [], 0),
    (["-r", "${1}x", "(hel)lo", "README.md"], ["2:helx and goodbye"], 0),
    (["-r", "$2-$1x-\\n", "(hel)lo", "README.md"], ["2:--\\n and goodbye"], 0),
    (["-o", "-r", "[$w]", "(?P<w>fo+) b", "words.txt"], ["2:[foo]"], 0),
    (["-F", "-r", "$0!", "foo.bar", "dots.txt"], ["1:foo.bar!", "3:afoo.bar!"], 0),
    (["--no-ignore", "-l", "hello"], ["README.md", "crlf.txt", "noext", "skipme.log", "skipme2.txt", "src/main.rs"], 0),
    (["--no-ignore-vcs", "-l", "hello hidden"], ["skipme.log"], 0),
    (["--no-ignore-dot", "-l", "hello hidden"], ["skipme2.txt"], 0),
    (["-u", "-l", "hidden"], ["skipme.log", "skipme2.txt"], 0),
    (["-uu", "-l", "hiddentoken"], [".github/workflows/ci.yml", ".hidden.txt"], 0),
    (["hiddentoken"], [], 1),
    (["--hidden", "-l", "hiddentoken"], [".github/workflows/ci.yml", ".hidden.txt"], 0),
    (["-g", "*.txt", "-l", "hiddentoken"], [".hidden.txt"], 0),
    (["-t", "txt", "-l", "hiddentoken"], [".hidden.txt"], 0),
    (["-g", "*.yml", "-l", "hiddentoken"], [], 2),
    (["-g", ".github", "-g", "*.yml", "-l", "hiddentoken"], [".github/workflows/ci.yml"], 0),
    (["-c", "hiddentoken", ".github"], [".github/workflows/ci.yml:1"], 0),
    (["-l", "keeptoken|wdirtoken|nopetoken"], ["dotkit/.keepme", "dotkit/.wdir/in.txt"], 0),
    (["-g", "!src", "-l", "hello"], ["README.md", "crlf.txt", "noext"], 0),
    (["binary"], [], 1),
    (["--binary", "binary"], ['binnul.bin: binary file matches (found "\\0" byte around offset 3)'], 0),
    (["binary", "binnul.bin"], ['binary file matches (found "\\0" byte around offset 3)'], 0),
    (["--binary", "-c", "binary"], ["binnul.bin:1"], 0),
    (["-a", "-c", "binary"], ["binnul.bin:1"], 0),
    (["-a", "--binary", "-l", "match"], ["binpre.bin", "ctx.txt"], 0),
    (["hit"], ["late.txt:1:early hit", f'late.txt: WARNING: stopped searching binary file after match (found "\\0" byte around offset {LATE})'], 0),
    (["-c", "hit"], [], 1),
    (["-l", "hit"], ["late.txt"], 0),
    (["-c", "hit", "late.txt"], ["2"], 0),
    (["-q", "hello"], [], 0),
    (["-q", "zz_no_match_zz"], [], 1),
    (["-m", "0", "foo"], [], 1),
    (["hello", "no_such_path"], [], 2),
    (["-q", "hello", "README.md", "no_such_path"], [], 0),
    (["-q", "zz_no_match_zz", "README.md", "no_such_path"], [], 2),
    (["-c", "hello", "no_such_path", "src"], ["src/main.rs:1"], 2),
    (["-m", "1", "-A", "2", "match", "ctx.txt"], ["2:match1", "3-ctx2", "4-match2"], 0),
    (["--heading", "-C", "1", "foo", "gap.txt", "mm.txt", "case.txt"], ["gap.txt", "1:foo", "2-x1", "--", "5-x4", "6:foo", "", "case.txt", "1:foo", "2-FOO"], 0),
    (["-C1", "--context-separator", "==", "--field-context-separator", "~", "foo", "gap.txt"], ["1:foo", "2~x1", "==", "5~x4", "6:foo"], 0),
    (["-0", "-l", "hello", "src"], ["src/main.rs\0"], 0),
    (["--path-separator", "%", "-l", "answer"], ["src%deep%util.rs"], 0),
    (["--max-depth", "1", "-l", "hello"], ["README.md", "crlf.txt", "noext"], 0),
    (["--trim", "padded"], ["pad.txt:1:padded line"], 0),
    (["--color", "always", "-N", "fn main"], ["\x1b[0m\x1b[35msrc/main.rs\x1b[0m:\x1b[0m\x1b[1m\x1b[31mfn main\x1b[0m() {"], 0),
    (["--files", "-g", "!*.txt", "-T", "rust"], ["README.md", "binnul.bin", "binpre.bin", "dotkit/.gitignore", "dotkit/.keepme", "noext"], 0),
    (["-U", "--multiline-dotall", "-c", "a.b\nc.d"], ["adjacent.txt:4"], 0),
    (["--sortr", "path", "-l", "foo"], ["words.txt", "gap.txt", "dots.txt", "case.txt", "README.md"], 0),
    (["--type-add", "mine:*.md", "--type-clear", "rust", "--type-add", "rust:nope", "-t", "mine", "-t", "rust", "-l", "hello"], ["README.md"], 0),
    (["--engine", "auto", "-o", "fo+(?= b)", "words.txt"], ["2:foo"], 0),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(text.encode())
    return str(at)


@pytest.fixture(scope="module")
def index(spark, root, tmp_path_factory):
    files = tree.with_content(tree.sweep(spark, root), root, encoding="none")
    return I.Index(spark, str(tmp_path_factory.mktemp("index") / "x")).open(files)


@pytest.fixture(scope="module")
def corpus(spark, root):
    files = tree.with_content(tree.sweep(spark, root), root, encoding="none")
    return spark.createDataFrame(files.collect(), files.schema).coalesce(2).cache()


@pytest.mark.parametrize("k", range(len(CASES)), ids=[" ".join(a) for a, _, _ in CASES])
def test_command_line(spark, root, corpus, index, k):
    argv, records, status = CASES[k]
    spec = parse_argv(argv)
    # Toggles of the sweep need one of their own, and every fifth case has one too.
    swept = spec.ignore != SearchSpec().ignore or k % 5 == 0
    found = search_tree(spark, root, argv, index) if swept else run(corpus, spec, index=index)
    assert found.lines() == records
    if status or k % 4 == 0 or argv[0] in ("-q", "-o"):
        assert found.exit_code() == status


def test_statistics(spark, root):
    got = search_tree(spark, root, ["--stats", "foo", "case.txt", "gap.txt"]).lines()
    assert got[:4] == ["case.txt:1:foo", "gap.txt:1:foo", "gap.txt:6:foo", ""]
    assert got[4:10] == ["3 matches", "3 matched lines", "2 files contained matches", "2 files searched", "43 bytes printed", "32 bytes searched"] and len(got) == 12
    assert search_tree(spark, root, ["-q", "--stats", "foo", "case.txt"]).lines()[1] == "1 matches"


def test_reading(spark, root, tmp_path):
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"zipneedle packed\n"))
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9 test\n")
    (tmp_path / "rules").write_text("latin*\n!p.gz\n")
    up = tmp_path.parent / "upper"
    up.write_text("#!/bin/sh\nexec tr a-z A-Z\n")
    up.chmod(0o755)
    at = str(tmp_path)
    for argv, records in ((["-z", "zipneedle"], ["p.gz:1:zipneedle packed"]), (["zipneedle"], []), (["-E", "latin-1", "café"], ["latin.txt:1:café test"]), (["--pre", str(up), "--pre-glob", "rules", "LATIN"], ["rules:1:LATIN*"]), (["--pre", "cat", "-c", "test"], ["latin.txt:1"]), (["--ignore-file", "rules", "--files"], ["p.gz", "rules"])):
        assert search_tree(spark, at, argv).lines() == records, argv
    with pytest.raises(UsageError):
        search_tree(spark, at, ["-E", "nope", "x"])


def test_types_and_nothing(spark, root):
    listed = search_tree(spark, root, ["--type-list"]).lines()
    assert len(listed) > 120 and "rust: *.rs" in listed and listed == sorted(listed)
    found = search_tree(spark, root, ["-g", "*.nope", "hello"])
    assert found.lines() == [] and found.exit_code() == 2 and "No files were searched" in found.errors()[0]
