import numpy as np
from pyspark.sql import functions as F

from seine.llm import chroma
from seine.llm.queries import QUERIES


def melody(seed, n=80):
    return np.frombuffer(chroma.sonify(np.random.default_rng(seed).standard_normal(n).tolist()), "<i2")


def test_alignment_finds_the_shift():
    a = melody(1)
    noise = np.random.default_rng(2).normal(0, 400, len(a))
    b = (a + noise)[20 * chroma.HOP :]
    offset, votes, error = chroma.align(chroma.fingerprint(a), chroma.fingerprint(b))
    assert offset == 20 and votes > 20 and error < 0.1
    assert chroma.bit_error(chroma.fingerprint(a), chroma.fingerprint(melody(3)), 0) > 0.2


def brute_frames(pcm):
    """Pitch-class energies by a plain Fourier sum of every window."""
    t = np.arange(chroma.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / (chroma.FRAME - 1))
    out = []
    for at in range(0, len(pcm) - chroma.FRAME + 1, chroma.HOP):
        energy = np.zeros(12)
        for k in range(chroma.FRAME // 2 + 1):
            hertz = k * chroma.RATE / chroma.FRAME
            if chroma.LOW <= hertz <= chroma.HIGH:
                x = (pcm[at : at + chroma.FRAME] * hann * np.exp(-2j * np.pi * k * t / chroma.FRAME)).sum()
                energy[round(12 * np.log2(hertz / 440)) % 12] += abs(x) ** 2
        out.append(energy / np.linalg.norm(energy))
    return np.array(out)


def test_fingerprint_against_plain_sums():
    """Filters as sums over the frames themselves, not over their integral image."""
    pcm = melody(8, 14).astype(np.float64)
    c = brute_frames(pcm)
    assert np.allclose(chroma.frames(pcm), c, atol=1e-4)
    got, near = chroma.fingerprint(pcm), 0
    for i, x in enumerate(got):
        bits = 0
        for shape, first, classes, width in chroma.FILTERS:
            mean = lambda t0, t1, p0, p1: c[i + t0 : i + t1, p0:p1].mean()  # noqa: B023, E731
            end, mid, half, third = first + classes, first + classes // 2, width // 2, width // 3
            value = {
                "pitch": lambda: mean(0, width, mid, end) - mean(0, width, first, mid),
                "time": lambda: mean(half, width, first, end) - mean(0, half, first, end),
                "quarter": lambda: mean(0, half, first, mid) + mean(half, width, mid, end) - mean(0, half, mid, end) - mean(half, width, first, mid),
                "bands": lambda: 2 * mean(third, 2 * third, first, end) - mean(0, third, first, end) - mean(2 * third, width, first, end),
            }[shape]()
            bits = bits << 2 | [0, 1, 3, 2][sum(value > cut for cut in chroma.CUTS)]
        near += (bits ^ int(x)).bit_count()
    assert len(got) == len(c) - chroma.WIDTH + 1 and near <= 1  # a value may lie on a cut


def test_several_at_once_are_each_alone():
    some = [melody(k, 9 + k % 3) for k in range(40)] + [melody(1)[:100], np.zeros(0, "<i2")]
    assert all(np.array_equal(x, chroma.fingerprint(y)) for x, y in zip(chroma.fingerprint_all(some), some))


def votes_of(a, b):
    """Frames of equal integers at every offset, pair by pair."""
    out = {}
    for i, x in enumerate(a.tolist()):
        for j, y in enumerate(b.tolist()):
            if x == y:
                out[i - j] = out.get(i - j, 0) + 1
    return out


def brute(own, queries):
    """{id: (class, {query: (votes, offset, bit error)})} as ``search`` says."""
    classes = {}
    for i, x in own.items():
        if len(x):
            classes.setdefault(x.tobytes(), []).append(i)
    out = {i: (min(classes[x.tobytes()]) if len(x) else None, {}) for i, x in own.items()}
    for key, ids in classes.items():
        mine, a = min(ids), own[ids[0]]
        for other, asked in classes.items():
            asked = [q for q in asked if q in queries and not (other == key and q == mine)]
            if not asked:
                continue
            b = own[asked[0]]
            found = {0: len(a)} if other == key else votes_of(a, b)
            if found:
                votes, offset = max((v, o) for o, v in found.items())
                if votes >= min(chroma.MIN_VOTES, len(a), len(b)):
                    out[mine][1][max(asked) if other == key and mine in queries else min(asked)] = (votes, offset, chroma.bit_error(a, b, offset))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, None if x is None else bytes(x), "x", 1) for i, x in rows], "vec_id long, audio binary, id string, class_id int")
    found = chroma.search(chroma.fingerprints(df, "vec_id", F.col("audio")), F.col("id") % 50 == 0).collect()
    own = {i: chroma.fingerprint(np.frombuffer(bytes(x or b"")[: len(bytes(x or b"")) // 2 * 2], "<i2")) for i, x in rows if i is not None}
    want = brute(own, {i for i in own if i % 50 == 0})
    for i, (kind, pairs) in want.items():
        mine = [r for r in found if r.id == i]
        assert {r.class_id for r in mine} == {kind}, i
        assert {r.query_id: (r.votes, r.offset, r.bit_error) for r in mine} == (pairs or {None: (None, None, None)}), i
    return found, want


def test_search_against_brute_force(spark):
    rows = [(i, melody(i).tobytes()) for i in range(12)] + [(50, melody(3)[4 * chroma.HOP :].tobytes()), (100, melody(5).tobytes()), (101, None), (102, b"\0\0\0"), (103, bytes(40_000)), (None, melody(1).tobytes())]
    found, want = check(spark, rows)
    got = {r.id: r for r in found if r.query_id is not None}
    assert (got[3].query_id, got[3].offset, got[5].query_id, got[5].bit_error) == (50, 4, 100, 0.0)
    assert {r.id for r in found} == {i for i, _ in rows}
    empty = spark.createDataFrame([], "vec_id long, audio binary")
    assert chroma.search(chroma.fingerprints(empty, "vec_id", F.col("audio")), F.col("id") % 50 == 0).count() == 0


def test_every_pair_short_copies_and_silence(spark):
    a, short = melody(20), melody(21)[: chroma.FRAME + (chroma.WIDTH + 2) * chroma.HOP]
    held = np.concatenate([melody(23, 9), np.zeros(9000, "<i2"), melody(24, 9), np.zeros(6000, "<i2")])
    rows = [(0, a), (50, a), (100, a[8 * chroma.HOP :]), (1, a[3 * chroma.HOP :]), (2, a), (150, short), (3, short), (4, melody(22))]
    rows += [(200, held), (201, held[chroma.HOP * 7 :]), (250, np.zeros(20_000, "<i2"))] + [(300 + k, np.zeros(20_000, "<i2")) for k in range(3)] + [(310 + k, np.zeros(9_000 + 700 * k, "<i2")) for k in range(4)]
    found, want = check(spark, [(i, x.tobytes()) for i, x in rows])
    assert set(want[1][1]) == {0, 100} and set(want[0][1]) == {50, 100} and set(want[3][1]) == {150}
    assert set(want[310][1]) >= {250} and set(want[250][1]) >= {200, 300} and want[301] == (250, {})


def test_silence_is_linear(spark):
    """A thousand silent recordings are one class, whatever number of them are queries."""
    df = spark.createDataFrame([(k, bytes(40_000 if k % 2 else 36_000)) for k in range(1000)], "vec_id long, audio binary")
    rows = chroma.search(chroma.fingerprints(df, "vec_id", F.col("audio")), F.col("id") % 50 == 0).collect()
    assert len(rows) == 1000 and {(r.id, r.query_id) for r in rows if r.query_id is not None} == {(0, 950), (1, 0)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = QUERIES["op6_chroma"](spark, sf).collect()
    want = brute({r.vec_id: chroma.fingerprint(np.frombuffer(chroma.sonify(r.embedding), "<i2")) for r in table}, {r.vec_id for r in table if r.vec_id % 50 == 0})
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, (r.class_id, {}))[1].update({r.query_id: (r.votes, r.offset, r.bit_error)} if r.query_id is not None else {})
    assert got == want
