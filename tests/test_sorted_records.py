"""Records are computed once, though a sort by ranges goes twice over what it sorts."""

import pytest

from seine.operators import lines as L
from seine.operators import search
from seine.operators.search import run
from seine.plans import regex as R
from seine.spec import parse_argv

TEXTS = {"a/x.txt": "nation station\nno\ntion\n\nmotion", "b.md": "none\nration ion\n", "c.txt": "", "d/e/f.rs": "x\nfiction\nx\nx\nx\naction\n"}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(p, t, k, len(t)) for k, (p, t) in enumerate(TEXTS.items())], "path string, content string, mtime long, size long").cache()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("argv", [["-o", "[a-z]+tion"], ["-o", "-r", "[$w]", "(?P<w>[a-z]+)tion"], ["-o", "-b", "--column", "[a-z]+tion"], ["-o", "x*"], ["-c", "tion"], ["-l", "tion"], ["-C1", "action"], ["--json", "tion"], ["--sortr", "modified", "tion"], ["-v", "[a-z]tion"], ["--vimgrep", "ti"]], ids=" ".join)
def test_records_are_written_once(spark, corpus, monkeypatch, argv):
    spec = parse_argv(argv)
    kept = [r.out for r in run(corpus, spec).text.collect()]
    monkeypatch.setattr(search, "MUCH", 0)
    found = run(corpus, spec)
    assert "text" not in vars(found)  # nothing is written for a status or for rows
    assert [r.out for r in found.text.collect()] == kept and kept
    assert "/records-" in found.text.inputFiles()[0] and "RLIKE" not in plan(found.text)


def test_matches_alone_take_no_positions(corpus):
    rows = run(corpus, parse_argv(["-o", "[a-z]+tion"])).rows
    assert "aggregate(" not in plan(rows) and sorted(r.x.match for r in rows.collect()) == ["action", "fiction", "motion", "nation", "ration", "station"]


def test_a_literal_is_looked_for_first(corpus):
    text = plan(L.marked(L.lines(corpus), "[a-z]+tion"))
    assert "Contains(" in text or "contains(" in text
    assert R.required_literals("[a-z]+tion") == ["tion"]
    assert R.required_literals("a(?!bcd)e", pcre=True) in (["a"], ["e"], None) and R.required_literals("(?<!abc)x|y", pcre=True) in (["x", "y"], None)
