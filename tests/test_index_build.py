"""How an index is built: runs of files, ranges of postings."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seine.operators import index as I


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["", "ab", "\u212aelvin \U0001f600 \xe9"] + ["the " + "".join(rng.choice("abc\xe9") for _ in range(rng.randrange(0, 60))) for _ in range(200)]


def brute(text):
    raw = text.encode()
    return {int.from_bytes(raw[k : k + 3], "big") for k in range(len(raw) - 2)}


def staged(texts, first=0, flagged=()):
    n = len(texts)
    flags = [pa.array([f == "too_large" and k in flagged for k in range(n)]) for f in I._FLAGS]
    return pa.record_batch([pa.array([f"f{first + k}" for k in range(n)]), *flags, pa.array(range(first, first + n), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["path", *I._FLAGS, "_n", "content"])


def test_runs_of_files(texts, monkeypatch):
    """A task holds the postings of few files at a time, in three arrays."""
    monkeypatch.setattr(I, "RUN", 300)
    half = len(texts) // 2
    out = list(I._grams(iter([staged(texts[:half], flagged=(1, 5)), staged(texts[half:], half)])))
    assert [p for b in out for p in b.column("path").to_pylist()] == [f"f{k}" for k in range(len(texts))] and len(out) > 3
    got = set()
    for b in out:
        assert "content" not in b.schema.names and b.column("tri").null_count >= b.num_rows - 1
        if b.column("tri")[0].is_valid:
            tri, n, at = (memoryview(b.column(c)[0].as_buffer()).cast(k) for c, k in (("tri", "i"), ("n", "i"), ("at", "H")))
            assert list(tri) == sorted(set(tri)) and sum(n) == len(at) <= 300 + max(len(brute(t)) for t in texts)
            each = iter(at)
            got |= {(t, b.column("_n")[0].as_py() + next(each)) for t, m in zip(tri, n) for _ in range(m)}
    assert got == {(x, k) for k, t in enumerate(texts) if k != 5 for x in brute(t)}


def test_postings_in_ranges(spark, texts, tmp_path, monkeypatch):
    """Ranges of few postings, and trigrams that are more than a range: the same postings, in sorted files."""
    monkeypatch.setattr(I, "RANGE", 60)
    corpus = spark.createDataFrame([(f"f{k}", t, k, len(t.encode())) for k, t in enumerate(texts)], "path string, content string, mtime long, size long").repartition(3)
    index = I.Index(spark, str(tmp_path / "x")).build(corpus)
    ids = {r.file_id: int(r.path[1:]) for r in index.manifest().collect()}
    got = [(r.tri, ids[r.file_id]) for r in index.postings().collect()]
    assert sorted(got) == sorted((x, k) for k, t in enumerate(texts) for x in brute(t))
    files = [pq.read_table(f).to_pylist() for f in (tmp_path / "x").glob("*/0/postings/part-*.parquet")]
    keys = [[(r["tri"], r["file_id"]) for r in f] for f in files]
    assert len(keys) > 20 and all(k == sorted(k) for k in keys)
    the = int.from_bytes(b"the", "big")
    assert sum(any(t == the for t, _ in k) for k in keys) > 1
    assert {r.path for r in index.candidates([[[the], [int.from_bytes(b"abc", "big")]]]).collect()} == {f"f{k}" for k, t in enumerate(texts) if "the" in t and "abc" in t}
    assert index.meta()["sizes"] == [len(got)] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"


def test_only_the_wanted_trigrams_leave_python(spark, texts):
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    wanted = [int.from_bytes(x, "big") for x in (b"the", b"abc", b"zzz")]
    got = sorted(map(tuple, I.postings(files, wanted).collect()))
    assert got == sorted((x, k) for k, t in enumerate(texts) for x in brute(t) & set(wanted))
    assert sorted(map(tuple, I.postings(files).collect())) == sorted((x, k) for k, t in enumerate(texts) for x in brute(t))


@pytest.mark.parametrize("name", ["and_candidates", "or_candidates", "icase_candidates"])
def test_queries_ask_for_what_the_plan_wants(spark, monkeypatch, name):
    from seine import registry

    asked, real = [], I.postings
    monkeypatch.setattr(registry.I, "postings", lambda files, wanted=None: asked.append(wanted) or real(files, wanted))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert asked[0] is not None and 2 <= len(asked[0]) < 100
