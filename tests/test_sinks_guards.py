"""Sinks, deletes and digests on real files, and guards that raise."""

import math
from collections import Counter

import pytest

from tamarack import sources
from tamarack.functions import text as X
from tamarack.operators import guards
from tamarack.operators import recommend as R


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def test_insert_replace_delete_clear(spark, tmp_path):
    path = str(tmp_path / "table")
    first = sources.insert(spark.createDataFrame([("a",), ("b",)], "name string"), path)
    second = sources.insert(spark.createDataFrame([("c",)], "name string"), path)
    stored = {r["id"]: r["name"] for r in spark.read.parquet(path).collect()}
    assert sorted(stored.values()) == ["a", "b", "c"] and len(stored) == 3
    assert {r["id"] for r in second.collect()}.isdisjoint({r["id"] for r in first.collect()})
    assert sources.delete_where(spark, path, "name like 'a%'") == 1 and sources.delete_where(spark, path, "name like 'a%'") == 0
    sources.replace(spark.read.parquet(path).selectExpr("id", "upper(name) as name"), path)  # it may read what it replaces
    assert Counter(r["name"] for r in spark.read.parquet(path).collect()) == {"B": 1, "C": 1}
    assert sources.clear(spark, path) == 2 and spark.read.parquet(path).columns == ["id", "name"] and ids(spark, path) == []


def test_reload_on_change(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    assert sources.replace_if_changed(spark, df, path) and not sources.replace_if_changed(spark, df, path)
    assert sources.replace_if_changed(spark, spark.range(5), path) and spark.read.parquet(path).count() == 5


def test_csv_sinks_and_limits(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x"'), (1, "a,b")], "k int, v string")
    sources.write_csv_bom(df, str(tmp_path / "bom"), "k", quoted=True)
    text = next((tmp_path / "bom").glob("part-*")).read_text(encoding="utf-8")
    assert text.splitlines() == ['\ufeff"k","v"', '"1","a,b"', '"2","say ""x"""']
    sources.write_csv_quoted(df, str(tmp_path / "quoted"))
    assert any('"say ""x"""' in p.read_text() for p in (tmp_path / "quoted").glob("part-*"))
    (tmp_path / "a.csv").write_text("\ufeffname,price\nx,1\ny,2\nz,3\n", encoding="utf-8")
    assert [r["name"] for r in sources.read_csv_lenient(spark, str(tmp_path / "a.csv"), ["name"], ["price"], limit=2).collect()] == ["x", "y"]
    assert sources.read_csv_first(spark, str(tmp_path / "none.csv"), "a int", 3).collect() == []
    rows = spark.createDataFrame([("b1", "m1", 1)], "brand string, model string, year int")
    more = spark.createDataFrame([("Kia EV 6",), (" ",), ("Solo",), ("Late X",)], "name string")
    assert [tuple(r) for r in sources.append_up_to(rows, more, "name", 3).collect()] == [("b1", "m1", 1), ("Kia", "EV 6", None), ("Solo", "Solo", None)]


def test_digests_and_notes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.txt").write_text("two")
    sources.write_digests(spark, str(tmp_path / "in"), str(tmp_path / "side"))
    assert sources.changed_files(spark, str(tmp_path / "in"), str(tmp_path / "side")).count() == 0
    (tmp_path / "in" / "a.txt").write_text("other")
    (tmp_path / "in" / "b.txt").unlink()
    (tmp_path / "in" / "c.txt").write_text("new")
    got = {r["path"].rpartition("/")[2]: r["state"] for r in sources.changed_files(spark, str(tmp_path / "in"), str(tmp_path / "side")).collect()}
    assert got == {"a.txt": "changed", "b.txt": "missing", "c.txt": "new"}
    sources.write_note(spark, str(tmp_path / "vault"), "A: b / c", {"type": "case"}, "see [[B]]\n")
    note = sources.read_vault(spark, str(tmp_path / "vault")).first()
    assert note["title"] == "A: b / c" and note["path"].endswith("/A-b-c.md") and note["links"] == ["B"]
    assert sources.read_jsonl_lenient(spark, str(tmp_path / "vault"), "a int").count() > 0
    sources.append(spark.range(2), str(tmp_path / "log"))
    sources.append(spark.range(1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_guards(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, y double")
    assert guards.joined_exactly(one, two, "id").count() == 2
    for left, right in ((one, two.where("id = 1")), (one.where("id = 2"), two), (one.union(one), two)):
        with pytest.raises(guards.GuardError):
            guards.joined_exactly(left, right, "id")
    assert guards.require_finite(two, "y") is two
    for bad in (math.nan, math.inf, None):
        with pytest.raises(guards.GuardError):
            guards.require_finite(spark.createDataFrame([(bad,)], "y double"), "y")
    assert guards.concatenated((one, 2), (one, 2)).count() == 4
    with pytest.raises(guards.GuardError):
        guards.concatenated((one, 3))
    assert [r["x"] for r in guards.first_distinct(one.union(one), "x", "id", 2).collect()] == ["a", "b"]
    with pytest.raises(guards.GuardError):
        guards.first_distinct(one, "x", "id", 3)
    rows = spark.range(20).selectExpr("id", "id % 2 as g")
    assert Counter((r["g"], r["is_eval"]) for r in guards.held_out(rows, "g", "id", 0.25).collect()) == {(0, True): 2, (0, False): 8, (1, True): 2, (1, False): 8}
    with pytest.raises(guards.GuardError):
        guards.held_out(spark.range(3).selectExpr("id", "id as g"), "g", "id", 0.25)


def test_chunks_are_slices(spark):
    text = "".join(chr(97 + i % 26) for i in range(997)) + "\n😀é" * 30
    got = spark.createDataFrame([(text,), ("",), (None,)], "x string").select(X.chunks("x", 52, 44).alias("c")).collect()
    assert got[0]["c"] == [text[i : i + 52] for i in range(0, len(text), 44)] and got[1]["c"] == got[2]["c"] == []


def test_profile_that_says_nothing_and_one_that_names_models(spark):
    car = spark.createDataFrame([(1, "宝马", "M1", "SUV", "纯电", 200000, 240000, 500, 5, 2950, "L2+", 90.0, 10, "家庭", "空间", "贵"), (2, "问界", "M2", "MPV", "燃油", 900000, 950000, 0, 7, 3100, "L2", 4.6, 99, "商务", "", "")],
                                "id int, brand string, model string, vehicle_type string, energy_type string, price_min int, price_max int, cltc_range int, seats int, wheelbase int, adas_level string, safety_score double, monthly_sales int, suitable_scenarios string, highlights string, weaknesses string")
    schema = "profile int, budget_max int, budget_min int, family_size int, commute_km int, has_home_charger boolean, preferred_type string, preferred_energy string, preferred_brands array<string>, concerns array<string>, mentioned_models array<string>"
    silent = (0, *[None] * 10)
    named = (1, 0, 0, 4, 0, False, "SUV", "", [], ["续航", "社交形象"], ["问界 M2"])
    got = {(r["profile"], r["id"]): r for r in R.recommend(spark.createDataFrame([silent, named], schema), car, "profile", "id").collect()}
    # by hand: 100*.25 + 100*.2 + 85*.15 + 82*.15 + 92*.1 + 90*.1 + 75*.05
    assert got[0, 1]["score"] == 92.0 and got[0, 1]["budget_score"] == 100.0 and got[0, 1]["reasons"][0] == "预算匹配度 100 分"
    assert got[1, 2]["rank"] == 1 and got[1, 2]["is_mentioned"] and got[1, 2]["reasons"][0] == R.REASONS["mentioned"]
    # by hand: 88*.25 + 86*.2 + 95*.15 + 82*.15 + 78*.1 + 4.6*.1 + 99*.05 - 10 + 12 + 10
    assert got[1, 2]["score"] == 91.0 and got[1, 2]["cautions"] == [R.CAUTIONS["price"], R.CAUTIONS["range"]]
    assert got[1, 1]["cautions"] == [R.CAUTIONS["charging"], R.CAUTIONS["range"], "贵"]
    kept = {(r["profile"], r["id"]) for r in R.recalled(car.crossJoin(spark.createDataFrame([silent, named], schema)), "profile").collect()}
    assert kept == {(0, 1), (0, 2), (1, 2)}
