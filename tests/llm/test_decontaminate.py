import hashlib
import pickle
import random
import re

import numpy as np
import pytest

from seine.llm import decontaminate as d
from seine.llm.queries import QUERIES


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window=10):
    low = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    w = low(text)
    hit, found, windows = set(), set(), {}
    for item, t in items:
        v = low(t)
        for i in range(max(1, len(v) - window + 1)) if v else ():
            windows.setdefault(tuple(v[i : i + window]), set()).add(item)
    for n in {len(p) for p in windows}:
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in windows:
                hit.update(range(j, j + n))
                found |= windows[tuple(w[j : j + n])]
    return len(w), len(hit), found - {None}


def row(text, items, doc_id):
    n, h, found = brute(text, items)
    return (doc_id, n, h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0)


def test_index_matches_naive_search():
    rng = np.random.default_rng(1)
    for n, alphabet in ((40, 2), (300, 3), (500, 40)):
        seq = rng.integers(0, alphabet + 1, n)
        seq[-1] = 0
        index = d.FMIndex(seq, alphabet)
        lengths = rng.integers(1, 5, 200)
        patterns = rng.integers(1, alphabet + 1, (200, 5))
        got = {}
        for k, lo, hi in zip(*index.search(patterns, lengths)):
            got[k] = sorted(index.locate(np.arange(lo, hi)).tolist())
        for k in range(200):
            p = patterns[k, : lengths[k]].tolist()
            assert got.get(k, []) == [i for i in range(n) if seq[i : i + len(p)].tolist() == p]


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_against_brute_force(spark, block):
    random.seed(5)
    word = lambda: random.choice("the a of and Idiot ist éa b2 x zz".split())
    text = lambda n: " ".join(word() + random.choice(["", ".", "\n", "-"]) for _ in range(n))
    items = [(i, text(random.choice([3, 9, 10, 14, 25]))) for i in range(12)] + [(50, ""), (51, None), (52, "!!"), (7, "zz zz zz zz"), (None, "éa b2 x of of"), (None, text(12))]
    docs = [(i, text(random.randint(0, 200))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[0][1] * 3), (103, items[4][1]), (103, items[4][1]), (104, "the " * 30000 + items[5][1])]
    ddf = spark.createDataFrame([(i, t, "x", t) for i, t in docs], "doc_id long, text string, item_id string, words string")
    bdf = spark.createDataFrame(items, "item_id long, text string")
    got = d.digest(d.find(ddf, bdf, block_words=block)).collect()
    assert sorted(map(tuple, got)) == sorted(row(t, items, i) for i, t in docs)
    cleaned = d.remove(ddf, bdf, block_words=block)
    assert cleaned.columns == ddf.columns and cleaned.count() == len(docs)
    assert all(brute(r.text, items)[1] == 0 for r in cleaned.collect())
    clean = {i: t for i, t in docs if brute(t, items)[1] == 0}
    assert {r.doc_id: r.text for r in cleaned.collect() if r.doc_id in clean} == clean


@pytest.mark.parametrize("bits", [4, 10])
def test_words_of_one_hash(monkeypatch, bits):
    """Hashes cut to a few bits collide everywhere, in the benchmark and in documents; results stay the same."""
    real = d.words

    def cut(column, keep):
        w = real(column, keep)
        w.hash = w.hash & np.uint64(2**bits - 1)
        return w

    monkeypatch.setattr(d, "words", cut)
    rng = random.Random(bits)
    text = lambda n, m: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    items = [(k, text(rng.choice([4, 12, 20]), 9)) for k in range(6)]
    phrases = d.Phrases.of(items)
    assert phrases.ambiguous or bits > 4
    docs = [text(60, 12) for _ in range(20)] + [f"{text(5, 40)} {t} {text(400, 400)}" for _, t in items]
    w, hit, pairs = d.search_shard(d.pa.array(docs), [phrases])
    for r, t in enumerate(docs):
        n, hits, found = brute(t, items)
        assert (w.first[r + 1] - w.first[r], hit[w.row == r].sum(), set(pairs[pairs[:, 0] == r, 1].tolist())) == (n, hits, found)


def test_blocks_are_small_as_built():
    rng = random.Random(2)
    text = " ".join(f"{rng.randrange(50_000):x}" for _ in range(100_000))
    assert len(pickle.dumps(d.Phrases.of([(k, text[k * 5000 : k * 5000 + 5000]) for k in range(len(text) // 5000)]))) < 100 * 100_000


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.find(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], docs.schema)
    assert [tuple(r) for r in d.digest(d.find(some, items)).collect()] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op1_decontaminate"](spark, sf).collect())) == sorted(row(r.text, items, r.doc_id) for r in docs)
