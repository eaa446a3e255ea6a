import re
import zlib
from collections import defaultdict

import corpus_pipeline as c
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seine.llm import session, toxicity
from tests.llm.test_decontaminate import brute as occurrences
from tests.llm.test_neardup import brute as duplicates
from tests.llm.test_pii import brute as personal


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in c.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows)
            kept.append((name, before, {r.doc_id: r.text for r in rows}))
    (_, a, tox), (_, b, dup), (_, d, cut), (_, e, red) = kept
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    import pyarrow as pa
    ids = sorted(a)
    assert set(tox) == {i for i, s in zip(ids, model.score(pa.array([a[i].text for i in ids]))) if s < 0.5}
    assert set(dup) == {i for i, _, _, keep in duplicates([(i, r.text) for i, r in b.items()], 5) if keep}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(cut) == set(d) and all(occurrences(t, items)[1] == 0 for t in cut.values())
    assert all(cut[i] == r.text for i, r in d.items() if occurrences(r.text, items)[1] == 0)
    assert set(red) == set(e) and not any(personal(t) for t in red.values())
    assert not any(re.search(r"token = .[0-9a-f]{40}", t) for t in red.values())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    assert {i: b"".join(x for _, x in sorted(v)) for i, v in pieces.items()} == {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in red.items()}


def odd(spark, at, rows):
    """Tables of a folder: documents with columns whose names operators use, and few labels and items."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, node long, digest binary, spans string, items array<long>"
    spark.createDataFrame([(i, t, "en", None, len(t or ""), 0.5, 1, b"x", "s", [1]) for i, t in rows], columns).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i < 20)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_odd_rows(spark, tmp_path):
    text = lambda k: " ".join(f"w{(k * 7 + j) % 97}x{k}" for j in range(30))
    rows = [(i, f"you vile moron {text(i)}" if i < 20 else f"dear friend {text(i)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, None), (None, text(200)), (103, text(300)), (103, text(300)), (104, text(300) + " more"), (105, "mail a.b@example.org now " + text(400))]
    rows += [(106, "so one two three four five six seven eight nine ten eleven ends " + text(500)), (107, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (108, "dear friend of mine " * 40_000)]
    sf = odd(spark, tmp_path / "odd", rows)
    docs = c.documents(spark, sf)
    columns = docs.columns
    for name, stage in c.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else []
        assert docs.columns == columns or name == "packing"
        if name == "toxicity":
            kept = {i for i, _ in got}
            assert kept >= {100, 101, 102, 108, None} and len(kept & set(range(20))) < 5 < 15 < len(kept & set(range(20, 40)))
            docs = docs.union(c.documents(spark, sf).where("doc_id between 103 and 107").join(docs.select("doc_id"), "doc_id", "left_anti"))  # so few words tell little
            docs.write.parquet(f"{tmp_path}/all")
            docs = spark.read.parquet(f"{tmp_path}/all")
        elif name == "near_dedup":
            assert [i for i, _ in got].count(103) == 2 and 104 not in dict(got) and {100, 101, 102, None, 108} <= set(dict(got))
        elif name == "decontamination":
            assert dict(got)[107].strip() == "" and " ten " not in dict(got)[106] and dict(got)[100] is None and dict(got)[101] == ""
        elif name == "pii":
            assert dict(got)[105].startswith("mail [EMAIL] now") and dict(got)[100] is None
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} >= {100, 101, 102, None, 103, 108} and sum(r.length for r in pieces if r.doc_id == 100) == 1
    assert max(r.offset + r.length for r in pieces) <= 2048


def test_empty_table(spark, tmp_path):
    sf = odd(spark, tmp_path / "none", [])
    docs = c.documents(spark, sf)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_run_leaves_one_table(spark):
    before = set(session.made())
    assert c.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session.made() if p not in before] == ["pipeline-packing"]
