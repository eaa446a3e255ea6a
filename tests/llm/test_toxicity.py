import zlib

import numpy as np

from seine.llm import toxicity as t
from seine.llm.queries import QUERIES


def test_risk_learns_from_unlabelled():
    rng = np.random.default_rng(0)
    def draw(n, toxic):
        x = (rng.random((n, 40)) < 0.3).astype(np.float32)
        x[:, :3] = rng.random((n, 3)) < (0.9 if toxic else 0.02)
        return x
    w = t.nnpu(draw(300, True), np.vstack([draw(900, False), draw(100, True)]), 0.1)
    accuracy = [((x @ w[:-1] + w[-1] > 0) == y).mean() for x, y in ((draw(500, True), True), (draw(500, False), False))]
    assert min(accuracy) > 0.9


def test_score_against_plain_words():
    """A score from the words and affixes of a text, one by one."""
    rng = np.random.default_rng(4)
    texts = ["Some héllo words, some UNCOMMONLY long; x", "", None, "a b c " * 50, "Idiotisch und so"]
    named = lambda w: {(w[:n], n, 0) for n in t.AFFIXES if len(w) > n} | {(w[-n:], n, 1) for n in t.AFFIXES if len(w) > n} | {(w, 0, 0)}
    # The hash of an affix is that of the bytes, told apart by length and end: take it from the texts themselves.
    words = t.words(t.pa.array(["uncommonly"]), t.ALNUM)
    row, bucket = t.features(words)
    assert len(bucket) == len(named(b"uncommonly")) and len(set(bucket.tolist())) == len(bucket)
    every = np.unique(np.concatenate([t.features(t.words(t.pa.array([x]), t.ALNUM))[1] for x in texts]))
    buckets = np.sort(rng.choice(every, len(every) // 2, replace=False)).astype(np.int64)
    model = t.Model(buckets, rng.standard_normal((3, len(buckets) + 1)), 0.2)
    for x, got in zip(texts, model.score(t.pa.array(texts))):
        have = set(t.features(t.words(t.pa.array([x]), t.ALNUM))[1].tolist())
        if not have:
            assert got == 0.2
            continue
        members = [1 / (1 + np.exp(-(m[-1] + sum(v for b, v in zip(buckets.tolist(), m) if b in have)))) for m in model.weight]
        assert abs(got - np.mean(members)) < 1e-9


def test_odd_rows(spark):
    docs = [(i, f"you {'moron' if i % 4 == 0 else 'friend'} word{i}", "x") for i in range(200)] + [(500, None, None), (501, "", "y"), (3, "you friend word3", "x"), (502, "fine " * 50_000 + "moron", "x")]
    docs += [(7, "you friend word7", "x")] * 300  # one row, repeated, is learned from once
    docs += [(4, f"you moron again {k}", "x") for k in range(3)]  # an id of many texts
    ddf = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(120)] + [(None, 1, None), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = t.train(ddf, labels)
    seen = []
    real = t.fit
    t.fit = lambda p, u, *a: seen.append((len(p), len(u))) or real(p, u, *a)
    try:
        t.train(ddf, labels, positives=20, unlabelled=90)
        t.train(ddf, labels)
    finally:
        t.fit = real
    distinct = {(i, x) for i, x, _ in docs if x is not None and zlib.crc32(str(i).encode()) % 5}
    assert seen == [(20, 90), (sum(i % 4 == 0 and i < 120 for i, _ in distinct), len(distinct))]
    rows = t.score(ddf, model).collect()
    assert len(rows) == len(docs) and t.score(ddf, model).columns == ["doc_id", "text", "toxicity"]
    assert t.clean(ddf, model).columns == ddf.columns and {r.doc_id for r in t.clean(ddf, model).collect()} == {r.doc_id for r in rows if r.toxicity < 0.5}
    wrong = [(r.doc_id, r.toxicity) for r in rows if (r.toxicity >= 0.5) != ("moron" in (r.text or ""))]
    assert not wrong, wrong
    assert t.score(ddf.limit(0), model).count() == 0
    none = t.train(ddf, labels.limit(0))
    assert {r.toxicity for r in t.score(ddf, none).collect()} == {0.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(truth[i], r.predicted) for i, r in rows.items() if r.held_out and i in truth]
    hit = sum(a and b for a, b in held)
    print('recall', hit / sum(a for a, _ in held), 'precision', hit / sum(b for _, b in held))
    assert hit / sum(a for a, _ in held) > 0.85 and hit / sum(b for _, b in held) > 0.92
