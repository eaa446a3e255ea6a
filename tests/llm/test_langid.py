import zlib

import numpy as np

from seine.llm import langid
from seine.llm.queries import QUERIES


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid.Network.new(["a", "b", "c"])
    net.parts = [p.astype(np.float64) for p in net.parts]
    x, y = rng.integers(0, 256, (5, 20)), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(x, y)
    for part, grad in zip(net.parts, g):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in part.shape) if part is not net.parts[0] else (int(x[0, rng.integers(0, 20)]), int(rng.integers(0, langid.DIM)))
            keep = part[at]
            part[at] = keep + 1e-5
            up, _ = net.gradients(x, y)
            part[at] = keep - 1e-5
            down, _ = net.gradients(x, y)
            part[at] = keep
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_windows_cover_texts():
    raw = np.frombuffer(b"x" * 600 + b"y" * 3, np.uint8)
    w, owner, share = langid.windows(raw, np.array([0, 600, 600, 603]))
    assert owner.tolist() == [0, 0, 0, 1, 2] and w[:3].reshape(-1)[:600].tobytes() == b"x" * 600
    assert np.allclose(np.bincount(owner, share), 1)


def test_odd_rows(spark):
    docs = [(i, ("the cat and the dog sat " if i % 2 else "der hund und die katze ") * 12, "en" if i % 2 else "de") for i in range(80)]
    docs += [(200, None, None), (201, "", "en"), (202, "12 !", None), (3, docs[3][1], "en"), (203, "the cat sat " * 20_000, None), (204, "the", None)]
    docs += [(205, "½²", "de"), (206, "①②", None), (207, "Ⅷ 12", None), (208, "é", None)]
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, lang string, score double, lang_pred string")
    rows = langid.identify(df, langid.train(df)).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in (200, 201, 202, 205, 206, 207)] == ["und"] * 6 and got[208].lang_pred != "und" and got[203].lang_pred == "en"
    assert all(got[i].lang_pred == la for i, _, la in docs[:80]) and all(0 <= r.score <= 1 for r in rows)
    none = langid.train(df.where("doc_id = 200"))
    assert none is None and {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), none).count() == 0


def test_forward_pass_against_loops():
    """The network's probabilities, position by position in plain loops."""
    rng = np.random.default_rng(3)
    net = langid.Network.new(["a", "b"])
    x = rng.integers(0, 256, (3, 12))
    embed, out_w, out_b = net.parts[0], net.parts[-2], net.parts[-1]
    for row, got in zip(x, net.probabilities(x)):
        pooled = []
        for k, w in enumerate(langid.WIDTHS):
            kernel, bias = net.parts[1 + 2 * k : 3 + 2 * k]
            for f in range(langid.FILTERS):
                pooled.append(max(sum(float(embed[row[i + o], d]) * float(kernel[o * langid.DIM + d, f]) for o in range(w) for d in range(langid.DIM)) for i in range(len(row) - w + 1)) + float(bias[f]))
        z = [sum(max(v, 0) * float(out_w[i, c]) for i, v in enumerate(pooled)) + float(out_b[c]) for c in range(2)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(got, e / e.sum(), atol=1e-4)


def test_rare_languages_are_kept(spark):
    docs = [(i, "uno dos tres " * 5, "es") for i in range(900)] + [(10_000 + k, f"zz{k} yy xx " * 9, f"l{k:03d}") for k in range(300)]
    net = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), most=1300, folds=1, held_out=1)
    assert len(net.languages) == 301


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_langid"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    print("accuracy", np.mean(held))
    assert np.mean(held) > 0.97
