"""Retrieval on odd tables against its SQL, in small chunks and slices, and what it shuffles."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from tamarack.operators import retrieval
from tamarack.plans import registry

DOCS = [
    (1, "Alpha beta, gamma delta. Alpha"),
    (1, "beta alpha epsilon"),
    (2, None),
    (None, "alpha beta gamma zeta"),
    (None, "eta alpha"),
    (3, ""),
    (4, "alpha beta gamma delta"),
    (5, "alphabet (beta) gamma-delta x" * 40),
    (6, "ÉTÉ 中文 ñandú beta_1 \U00020000a \n\n"),
    *((100 + i, "same copy of beta and gamma") for i in range(9)),
    *((200 + i, f"word{i} beta, gam" + " de" * (i % 4)) for i in range(30)),
]
ASKS = [(1, "alpha beta, gam"), (1, "delta (beta)"), (2, "de gamma - ñandú"), (3, None), (4, "unknown"), (None, "alpha"), (5, "beta beta été beta_1 \U00020000a"), (6, "gamma\ndelta. de")]


def shuffled(spark) -> int:
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


@pytest.mark.parametrize("sizes", [(8 << 20, 1 << 17), (256, 8)], ids=["whole", "small"])
@pytest.mark.parametrize("name", ["tfidf_topk", "hybrid_retrieval"])
def test_odd_tables(spark, tmp_path, monkeypatch, name, sizes):
    monkeypatch.setattr(retrieval, "CHUNK_BYTES", sizes[0])
    monkeypatch.setattr(retrieval, "SCORES", sizes[1])
    con = duckdb.connect()
    for table, rows, key in (("documents", DOCS, "doc_id"), ("benchmark", ASKS, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    result = con.execute(registry.ORACLE_SQL[name])
    places = [df.columns.index(c[0]) for c in result.description]
    assert Counter(tuple(r[i] for i in places) for r in df.collect()) == Counter(result.fetchall())


@pytest.mark.parametrize("name", ["tfidf_topk", "hybrid_retrieval"])
def test_no_pairs_are_shuffled(spark, name):
    folder = "/root/testdata/sf0.01"
    size = sum(len((r[0] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect())
    before = shuffled(spark)
    registry.QUERIES[name](spark, folder).collect()
    assert shuffled(spark) - before < 3 * size


def test_texts_and_digests_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 5000):
        high = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (retrieval._wide(retrieval._narrow(high), n) == high).all()
        counts = rng.integers(0, 600, n)
        assert (retrieval._unpacked(retrieval._packed(counts), n) == counts).all()
    assert retrieval._whole("a b", "_, _.") == "a, b."
    assert retrieval._whole("", " - ") == " - "
    assert retrieval._whole("a", "_") == "a"
