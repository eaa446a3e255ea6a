import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seine.llm import packing, tokenfile, tokens
from seine.llm.queries import QUERIES
from seine.llm.text import gathered
from seine.llm.tokens import encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
plain = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}


def ids(file, text):
    return plain[file].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="abcXYZéÈßÿ012 \n\t.,'!?sS<|>-_—²ªµ́\x85\x1c")), max_size=3))
def test_ids_are_the_librarys(file, texts):
    got = encoder(public_tokenizers.path(file)).encode(texts)
    assert [x.tolist() for x in got] == [ids(file, t) for t in texts]


@pytest.mark.parametrize("file", FILES)
def test_odd_texts(file):
    texts = [None, "", "<|endoftext|> a", "it's  It'S 'llama\n\n x\n", " \n ", "I don't\tknow ... 12 345", "a" * 5000, "Œuvre œ «¿no?»", "İstanbul", "ǆ", "x\xa0y"]
    assert [x.tolist() for x in encoder(public_tokenizers.path(file)).encode(texts)] == [ids(file, t) for t in texts]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="'  \n\tstremvldaSÉœ09!.¿—…"), max_size=6))
def test_byte_level_cut_is_the_librarys(texts):
    each = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, each)])
    raw = b"".join(each)
    start = [*tokens.byte_level_starts(np.frombuffer(raw, np.uint8), at).tolist(), len(raw)]
    want = [t[a:b] for t in texts for _, (a, b) in plain[FILES[1]].pre_tokenizer.pre_tokenize_str(t)]
    assert [raw[a:b].decode() for a, b in zip(start, start[1:])] == want
    assert [x.tolist() for x in encoder(public_tokenizers.path(FILES[1])).encode(texts)] == [ids(FILES[1], t) for t in texts]


def invented(n, rng):
    parts = "th an in er on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é".split()
    return [" ".join("".join(rng.choices(parts, k=rng.choice([1, 1, 2, 2, 3, 4, 5]))) for _ in range(400)) for _ in range(n)]


def test_memo_forgets_rightly(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 300)
    enc, rng = tokens.Encoder(public_tokenizers.path(FILES[1])), random.Random(6)
    for _ in range(12):
        texts = [*invented(4, rng), "x" * 200 + " y"]
        assert [x.tolist() for x in enc.encode(texts)] == [ids(FILES[1], t) for t in texts]
        assert len(enc.keys) == len(enc.values) == len(enc.uses) <= 300 and b"x" * 200 not in enc.keys.to_pylist()


def test_byte_level_ids_cost_little():
    """Of the CPU time that the library takes for texts of many new words; the best of three, as machines are shared."""
    texts, path = invented(6000, random.Random(5)), public_tokenizers.path(FILES[1])
    shares = []
    for _ in range(3):
        enc, took = tokens.Encoder(path), []
        for encode in (enc.encode, enc._whole):
            began = time.process_time()
            for k in range(0, len(texts), 2000):
                encode(texts[k : k + 2000])
            took.append(time.process_time() - began)
        shares.append(took[0] / took[1])
    assert min(shares) < 0.7, shares


def test_batches_are_gathered():
    batches = [pa.record_batch({"text": ["x" * n] * 2}) for n in (10, 1000, 5000, 10, 10)]
    got = list(gathered(batches, "text", 3000))
    assert [b.num_rows for b in got] == [4, 2, 4] and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
    assert list(gathered([], "text", 10)) == []


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 20])
def test_bits_round_trip(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1001)
    raw = tokenfile.pack(x, width)
    assert len(raw) == -(-1001 * width // 8)
    assert tokenfile.unpack(raw, width, 1001).tolist() == x.tolist()


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30_000, n) for n in (0, 5, 1000, 3, 0, 257)]
    w = tokenfile.Writer(open(tmp_path / "x", "wb"), 30_000, 1, block=64)
    for i, d in enumerate(docs):
        w.add(i * 10, d)
    w.close()
    r = tokenfile.Reader(str(tmp_path / "x"))
    assert r.width == 15 and r.docs.tolist() == [0, 10, 20, 30, 40, 50]
    assert [r.document(k).tolist() for k in (4, 2, 0, 5, 1, 3)] == [[*docs[k], 1] for k in (4, 2, 0, 5, 1, 3)]
    whole = np.concatenate([np.append(d, 1) for d in docs])
    assert r.range(60, 700).tolist() == whole[60:700].tolist()


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


TEXTS = [(5, "one two"), (3, None), (3, "b"), (3, "b"), (9, ""), (1, "word. " * 30_000), (None, "x")]
#: Many rows without an id, which may begin several files.
NAMELESS = [(None, f"text {k}") for k in range(200)] + [(-1, "y")]


def test_files(spark):
    df = spark.createDataFrame([(i, t, 7, "p") for i, t in TEXTS], "doc_id long, text string, start long, path string")
    rows = tokenfile.read(tokenfile.write(df, public_tokenizers.path(FILES[0]))).collect()
    want = [(i, [*ids(FILES[0], t), 1]) for i, t in TEXTS]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(((i, len(x), crc(x)) for i, x in want), key=str)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 3, 3, 5, 9]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    nameless = spark.createDataFrame(NAMELESS, "doc_id long, text string").repartition(4)
    rows = tokenfile.read(tokenfile.write(nameless, public_tokenizers.path(FILES[0]))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, -1)] + [(True, 0)] * 200
    assert tokenfile.read(tokenfile.write(df.limit(0), public_tokenizers.path(FILES[0]))).count() == 0


def naive(b, penalty, window):
    best = [0.0]
    for j in range(1, len(b)):
        best.append(penalty[j] + min(best[i] + packing.padding(int(b[j] - b[i]), window) for i in range(j) if b[j] - b[i] <= window))
    return best[-1]


def test_cuts_are_optimal():
    random.seed(2)
    for _ in range(60):
        window = random.choice([16, 64])
        b = np.cumsum([0, *(random.randint(1, random.choice([3, window])) for _ in range(random.randint(1, 60)))])
        penalty = np.array([random.choice([0, 2, 9]) for _ in b])
        c = packing.cuts(b, penalty, window)
        assert c[0] == 0 and c[-1] == len(b) - 1
        cost = sum(penalty[j] + packing.padding(int(b[j] - b[i]), window) for i, j in zip(c, c[1:]))
        assert cost == naive(b, penalty, window)


def check_pieces(rows, texts, ids_of):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    pad = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist()
        n = sum(r.length for r in s)
        assert 0 < n <= 2048
        pad += packing.padding(n)
    return docs, pad / (pad + sum(r.length for r in rows))


def test_pieces(spark):
    texts = [(i, t) for i, t in TEXTS if i != 3] + [(3, None), (4, "nosentence" * 20_000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, length long")
    out = packing.pack(df, public_tokenizers.path(FILES[1]))
    docs, _ = check_pieces(out.collect(), texts, None)
    for (i, n), rows in docs.items():
        rows.sort(key=lambda r: r.start)
        want = [*ids(FILES[1], dict(texts)[i]), 1]
        assert n == len(want) and [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist()
        assert b"".join(bytes(r.ids) for r in rows) == np.array(want, "<u4").tobytes()
    assert len(docs) == len(texts) and packing.pack(df.limit(0), public_tokenizers.path(FILES[1])).count() == 0


def test_queries(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_pack"](spark, sf).collect()
    docs, padded = check_pieces(rows, texts, None)
    assert padded < 0.01 and {k for k, _ in docs} == set(texts)
    for (i, _), got in docs.items():
        want = [*ids(FILES[1], texts[i]), 1]
        for r in got:
            assert r.ids_crc32 == crc(want[r.start : r.start + r.length])
        assert sorted(r.start for r in got)[0] == 0 and sum(r.length for r in got) == len(want) == got[0].doc_tokens
    start = 0
    for r in sorted(QUERIES["op3_tokenfile"](spark, sf).collect(), key=lambda r: r.doc_id):
        want = [*ids(FILES[0], texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), crc(want))
        start += len(want)
