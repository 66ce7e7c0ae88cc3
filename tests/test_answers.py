"""Hand cases and brute force for profiles and for the checks of model answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tamarack import sources
from tamarack.operators import answers as A
from tamarack.operators import audit
from tamarack.operators import profile as P


def greedy_by_hand(text, aliases):
    """Try every match in order of preference against the ones already kept."""
    spots = [(p, -len(a), i, n) for p, a, n in aliases for i in range(len(text)) if text.startswith(a, i)]
    kept = []
    for _, size, at, name in sorted(spots):
        if all(at - size <= a or b <= at for a, b, _ in kept):
            kept.append((at, at - size, name))
    return [n for _, _, n in sorted(kept)]


def test_greedy_names_match_brute_force(spark):
    rng = random.Random(3)
    aliases = [(rng.randrange(2), "".join(x), "".join(x)) for n in (1, 2, 3) for x in itertools.product("ab", repeat=n)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "i int, x string")
    got = {r["i"]: r["n"] for r in df.select("i", A.greedy_names(aliases)("x").alias("n")).collect()}
    assert got.pop(-1) == []
    assert got == {i: greedy_by_hand(x, aliases) for i, x in enumerate(texts)}


def test_pairing_hand_cases(spark):
    head = [("system", None), ("user", None)]
    cases = {
        "ok": ([("assistant", "a"), ("tool", "a"), ("assistant", "b"), ("tool", "b"), ("assistant", None)], None),
        "start": ([], "bad start"),
        "twice": ([("assistant", "a"), ("tool", "a"), ("assistant", "a")], "duplicate call"),
        "reused": ([("assistant", "a"), ("tool", "a"), ("tool", "a")], "unknown call"),
        "other": ([("assistant", "a"), ("tool", "b")], "unknown call"),
        "open": ([("assistant", "a"), ("assistant", None)], "missing result"),
        "end": ([("assistant", "a")], "pending at the end"),
        "late": ([("assistant", None), ("assistant", None)], "after the end"),
        "role": ([("user", None)], "late role"),
    }
    rows = [(key, i, role, call) for key, (tail, _) in cases.items() for i, (role, call) in enumerate((head if key != "start" else head[::-1]) + tail)]
    df = spark.createDataFrame(rows, "key string, idx int, role string, call_id string")
    assert {r["key"]: r["error"] for r in A.pairing_errors(df).collect()} == {k: e for k, (_, e) in cases.items()}
    assert A.pairing_errors(df.limit(0)).collect() == []


def test_grounded_score_of_empty_and_wrong_answers(spark):
    answers = spark.createDataFrame([(1, None, 1), (2, "The X size is 5", 1), (3, "X size is 55. X size is 5!", 1), (4, "X size is 55", 0)], "key int, answer string, minimum int")
    claims = spark.createDataFrame([(k, "X", "size", "5", "t", "l") for k in (1, 2, 2, 3, 4)], "key int, entity string, attribute string, value string, tool string, locator string")
    got = {r["key"]: (r["matched"], r["unsupported"], round(r["total"], 4)) for r in A.grounded_score(answers, claims).collect()}
    assert got == {1: (0, 0, 0.0), 2: (1, 0, 1.0), 3: (1, 1, 0.775), 4: (0, 1, 0.1)}


def test_profiles_of_null_and_empty_questions(spark):
    df = spark.createDataFrame([(None,), ("",), ("预算0万，0口人的家，二胎，没有家充但有充电桩",)], "ask string")
    rows = P.with_profile(df).withColumn("confidence", P.confidence()).select("budget_max", "family_size", "has_home_charger", F.size("concerns").alias("n"), "confidence").collect()
    assert [tuple(r) for r in rows] == [(None, None, None, 0, 0), (None, None, None, 0, 0), (None, 4, False, 1, 50)]


def test_divergence_ends_with_the_first_end_token(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [0.0, 1.0, 2.0], [5, 9, 9]), ([0.0], [0.0], [1]), ([], [], [])], "p array<double>, r array<double>, k array<int>")
    got = [r[0] for r in df.select(A.token_kl(F.col("p"), F.col("r"), F.col("k"), 9)).collect()]
    assert [[round(x, 6) for x in g] for g in got] == [[0.0, 0.718282], [0.0], []]


def test_names_and_copies_of_nothing(spark):
    df = spark.createDataFrame([("", "")], "x string, e string")
    row = df.select(A.copy_ratio(df.x, df.e), A.duplicate_ratio(df.x, F.split("e", " ")), P.vehicle_mentions(df.x)).first()
    assert tuple(row) == (0.0, 0.0, [])


def test_grounding_audit_hand_cases(spark):
    rows = [
        ("续航 10-20 km", "续航20至10公里", []),
        ("12 kWh", "12.50度", ["unsupported hard claim: 12 kWh"]),
        ("12.5度，12.5 度", None, ["unsupported hard claim: 12.5度"]),
        ("[2] 手册\n见[2]和[10]", "手册", ["unsupported bracket citation: [10]"]),
        ("[2] 年报", "手册", ["unsupported bracket source: [2] 年报"]),
        ("提供质保5年，请向官方确认。", "", []),
        (None, "x", ["answer is missing"]),
        ("", "", []),
    ]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(rows)], "i int, a string, e string")
    got = {r["i"]: r["x"] for r in df.select("i", audit.grounding_errors(F.col("a"), F.col("e")).alias("x")).collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(rows)}


def test_risks_and_scenarios_of_cases_without_rows(spark):
    cases = spark.createDataFrame([(1, 10.0, False), (2, None, None)], "k int, budget double, home_charger boolean")
    ranked = spark.createDataFrame([(2, 1, 99.0, "electric", None, 0)], "k int, rank int, price double, energy string, quality double, cautions int")
    assert {r["k"]: r["risks"] for r in audit.risk_checks(cases, ranked, "k").collect()} == {1: ["no candidates"], 2: ["none"]}
    asked = spark.createDataFrame([(1, ["a"], None, [], None), (2, None, None, None, None)], "k int, model_any array<string>, top_all array<string>, energy_any array<string>, type_any array<string>")
    rows = audit.scenario_checks(asked, spark.createDataFrame([], "k int, rank int, name string, energy string, type string"), "k").collect()
    assert {r["k"]: (r["passed"], r["checks"], r["status"]) for r in rows} == {1: (0, 1, "fail"), 2: (0, 0, "fail")}


def test_questions_at_any_depth(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text('[{"x": [{"query": "q1"}]}, {"role": "user", "content": "q2"}, {"role": "assistant", "content": "no"}, {"query": " "}]')
    (tmp_path / "b.jsonl").write_text('{"query": "q1"}\n\n{"query": {"query": "q3"}}\n{"query": "q1"}\n')
    got = sorted((r["path"].rsplit("/", 1)[1], r["query"]) for r in sources.scan_questions(spark, str(tmp_path)).collect())
    assert got == [("a.json", "q1"), ("a.json", "q2"), ("b.jsonl", "q1"), ("b.jsonl", "q3")]
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(Exception, match="invalid JSON"):
        sources.scan_questions(spark, str(tmp_path)).collect()
