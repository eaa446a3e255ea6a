"""Queries against their SQL over rows that the given tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from seine.registry import ORACLES, QUERIES


def same_as_sql(spark, sf, name, texts):
    """Texts by id as the table of documents."""
    n = len(texts)
    sf.mkdir(exist_ok=True)
    columns = {"doc_id": list(texts), "text": list(texts.values()), "lang": ["en"] * n, "source": [f"src{k % 3}" for k in texts], "n_chars": [len(t) for t in texts.values()]}
    pq.write_table(pa.table(columns), f"{sf}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = QUERIES[name](spark, str(sf))
    cur = duck.execute(ORACLES[name])
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(map(repr, map(tuple, df.select(*[c[0] for c in cur.description]).collect()))) == want
    return len(want)


def test_classes_at_the_bound(spark, tmp_path):
    sizes = (78_997, 78_998, 78_999, 79_000, 79_001, 79_500, 79_998, 79_999, 80_000, 80_001)
    texts = {k: "x" * sizes[k // 5] for k in range(5 * len(sizes))}
    assert same_as_sql(spark, tmp_path / "sf", "index_classes", texts) == len(texts)


def test_sweep_with_empty_texts(spark, tmp_path):
    texts = {k: "" if k % 4 == 0 else f"text {k}\n" for k in range(40)}
    assert same_as_sql(spark, tmp_path / "sf", "tree_sweep", texts) > 10
