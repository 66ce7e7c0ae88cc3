"""Every registered query against its SQL on the smallest tables, and the parts that SQL cannot express."""

import zipfile
from collections import Counter

import duckdb
import pytest

from tamarack import sources
from tamarack.functions import text as X
from tamarack.operators import rank as R
from tamarack.plans import registry
from tamarack.streaming import windows

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rows = Counter(tuple(r[c] for c in names) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    expected = Counter(tuple(r[columns.index(c)] for c in names) for r in result.fetchall())
    assert rows == expected


def test_nfkc_forms_collide(spark):
    df = spark.createDataFrame([("Ａ  b",), ("a B",), ("straße",), (None,)], "x string")
    assert [r[0] for r in df.select(X.nfkc_key("x")).collect()] == ["a b", "a b", "strasse", None]
    assert [r[0] for r in df.select(X.match_token("x")).collect()] == ["ab", "ab", "strasse", None]


def test_short_and_empty_texts_have_no_ngrams_or_chunks(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), (None,)], "x string")
    got = [tuple(r) for r in df.select(X.char_ngrams(df.x, 3), X.chunks(df.x, 2, 1)).collect()]
    assert got == [([], []), ([], ["ab", "b"]), (["abc"], ["ab", "bc", "c"]), ([], [])]


def test_quota_forces_the_last_place(spark):
    df = spark.createDataFrame([(1, "local", 9.0), (2, "local", 8.0), (3, "local", 7.0), (4, "real", 1.0)], "id int, source string, score double").selectExpr("'k' as k", "*")
    kept = R.with_source_quota(df, ["k"], "source", "real", [df.score.desc(), "id"], 2)
    assert sorted((r["id"], r["rank"]) for r in kept.collect()) == [(1, 1), (4, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,price\nx,\"1,200\"\ny,n/a\n", encoding="utf-8")
    got = sources.read_csv_lenient(spark, str(tmp_path / "a.csv"), ["name"], ["price"]).collect()
    assert [tuple(r) for r in got] == [("x", 1200.0), ("y", 0.0)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a"\n')
    good, bad = sources.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a int")
    assert [r["a"] for r in good.collect()] == [1]
    assert Counter(r["reason"] for r in bad.collect()) == {"blank": 1, "not an object": 1, "broken": 1}
    (tmp_path / "n.md").write_text("---\ntitle: T\n---\nsee [[B|x]] and [[A#y]]")
    note = sources.read_vault(spark, str(tmp_path)).first()
    assert (note["title"], note["links"]) == ("T", ["A", "B"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("r/src/b.json", '{"n": 2}')
        z.writestr("r/src/a.json", '{"n": 1}')
        z.writestr("r/other.json", "{}")
    assert [r["member"] for r in sources.read_zip_json(spark, str(tmp_path / "z.zip")).collect()] == ["r/src/a.json", "r/src/b.json"]
    out = str(tmp_path / "out")
    sources.write_jsonl(spark.createDataFrame([(2,), (1,)], "k int"), out, "k")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sources.write_jsonl(spark.createDataFrame([(2,)], "k int"), out, "k")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    started = windows.stream(spark, str(tmp_path / "in"), events.schema).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    started.awaitTermination()
    assert Counter(map(tuple, spark.table("daily").collect())) == Counter(map(tuple, windows.daily(events).collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 750
    assert set(entry.oracle_sql()) <= set(entry.queries())
