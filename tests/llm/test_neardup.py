import random
import re

import pyarrow as pa
import pytest

from seine.llm import neardup, session
from seine.llm.queries import QUERIES
from seine.llm.text import NONSPACE, words

LOW = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, percent=80):
    sets = [shingle_set(t, k) for _, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for j, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(j)
    for j, s in enumerate(sets):
        count = {}
        for x in s:
            for o in index[x]:
                if o < j:
                    count[o] = count.get(o, 0) + 1
        for o, both in count.items():
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(docs[o][0]), root(docs[j][0])))
                parent[b] = a
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(docs, sets))


def edited(words, n):
    w = list(words)
    for _ in range(n):
        w[random.randrange(len(w))] = f"e{random.randrange(10**6)}"
    return w


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    random.seed(k)
    docs = []
    for g in range(12):
        base = [f"w{random.randrange(60)}" for _ in range(random.choice([3, 12, 60, 300]))]
        for _ in range(random.choice([1, 3, 25])):
            docs.append(" ".join(edited(base, random.choice([0, 0, 1, 2, 5]) * (len(base) > 20))))
    chain = [f"c{i}" for i in range(200)]
    for i in range(15):  # neighbours are similar, the ends are not
        docs.append(" ".join(chain[i * 8 : i * 8 + 80]))
    docs += ["", None, "  \n", "one", "ONE", "one two", "A  b", "a b"] * 2 + ["x y " * 40_000]
    random.shuffle(docs)
    rows = list(enumerate(docs, 3))
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n long, node string")
    got = sorted(map(tuple, neardup.groups(df, k).collect()))
    assert got == brute(rows, k)
    kept = neardup.deduplicated(df, k)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in brute(rows, k) if r[3]]


def test_hot_keys_and_large_buckets(spark):
    """Salted keys and the meeting by rarity lose nothing either."""
    random.seed(9)
    footer = [f"f{i}" for i in range(60)]
    docs = [" ".join([f"b{k}-{i}" for i in range(random.choice([6, 9, 30]))] + footer) for k in range(60)]
    chain = [f"c{i}" for i in range(400)]
    docs += [" ".join(chain[i * 4 : i * 4 + 60] + footer[:20]) for i in range(40)]
    docs += [" ".join(edited(docs[k % 9].split(), k % 4)) for k in range(60)]
    random.shuffle(docs)
    rows = list(enumerate(docs, 3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    for options in ({"small": 3, "sample": 1, "hot": 3}, {"small": 2}):
        assert sorted(map(tuple, neardup.groups(df, 2, **options).collect())) == want, options


def test_footers_are_linear(spark, monkeypatch):
    """Texts that share two thirds and are not linked: pairs grow with the texts, not with their square."""
    footer = " ".join(f"f{i}" for i in range(200))
    counts = []
    real = neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *a: counts[-1].append(pairs.count()) or real(pairs, *a))
    for n in (300, 1200):
        counts.append([])
        df = spark.createDataFrame([(k, " ".join(f"b{k}-{i}" for i in range(100)) + " " + footer) for k in range(n)], "doc_id long, text string")
        assert neardup.groups(df, 2).where("kept").count() == n
    sums = [sum(c) for c in counts]
    assert sums[1] < 6 * sums[0]


def test_nothing_stays_but_what_is_read(spark):
    before = set(session.made())
    neardup.groups(spark.createDataFrame([(k, f"a b c d {k % 3}") for k in range(9)], "doc_id long, text string"), 2).count()
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in set(session.made()) - before} <= {"signatures", "edges"}


def test_tables_of_many_tasks_are_few_files(spark, monkeypatch):
    """Each file of a local file system starts processes, which look as large as the executor they are of."""
    files = {}
    real = session.Tables.write

    def write(self, df, name, **options):
        out = real(self, df, name, **options)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(session.Tables, "write", write)
    rows = [(k, " ".join(f"w{k // 4}-{i}" for i in range(60)) + f" end{k}") for k in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    assert neardup.groups(df, 2).where("kept").count() == 120
    assert {"signatures", "buckets", "sets", "links"} <= set(files) and max(files.values()) <= 4, files


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "p q r"), (2, "p q r"), (3, "a b c"), (None, "a b c"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.groups(df, 2).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True)], key=str)
    # Ids of several texts join the classes of all of them, however long the chain.
    df2 = spark.createDataFrame([(3, "a a1 a2"), (5, "a a1 a2"), (5, "b b1 b2"), (7, "b b1 b2"), (7, "c c1 c2"), (9, "c c1 c2")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.groups(df2, 2).collect()} == {(3, 3), (5, 3), (7, 3), (9, 3)}
    assert neardup.groups(df.limit(0)).count() == 0 and neardup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(6))
def test_few_words_alone(n):
    w = words(pa.array([" ".join("abcde"[:n])]), NONSPACE)
    for size in range(1, 7):
        h, first = neardup.shingles(w, size)
        assert len(h) == first[-1] == len(shingle_set(" ".join("abcde"[:n]), size))


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(random.randrange(200, 260), random.randrange(200, 260)) for _ in range(50)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if x != p}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_neardup"](spark, sf).collect())) == brute(docs, 2)
