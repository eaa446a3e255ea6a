"""The driver's entry, with the optional part and without."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["seine/llm", "tests/llm"], ["seine/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, gone):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(at / name) if (at / name).is_dir() else (at / name).unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 80 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})


def test_entry():
    if not (ROOT / "seine/llm").is_dir():
        pytest.skip("the optional part is not there")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and sum(n.startswith('op') and n[2].isdigit() for n in q) == 10"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
