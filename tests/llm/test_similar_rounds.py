"""Rounds of the near-duplicate search: where they are taken, and that components on the driver and in rounds agree."""

import random

from tamarack.llm import common, similar, simhash


def variants(groups: int, copies: int):
    """Texts in groups that share half of their words, below the similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = []
    for _ in range(groups):
        line = [word() for _ in range(60)]
        docs += [(len(docs) + i, " ".join(line + [word() for _ in range(40)])) for i in range(copies)]
    return docs


def star_rounds(spark, monkeypatch, docs) -> int:
    turns, real = [], similar._star_pairs
    monkeypatch.setattr(similar, "COMMON", 0)  # shared shingles come early too
    monkeypatch.setattr(similar, "_star_pairs", lambda state, turn: turns.append(turn) or real(state, turn))
    found = similar.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["id"]: r["component"] for r in found} == {d: d for d, _ in docs}
    return len(turns)


def test_small_groups_need_no_star_rounds(spark, monkeypatch):
    assert star_rounds(spark, monkeypatch, variants(3, 24)) == 0


def test_large_groups_take_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(similar, "LARGE", 16)
    monkeypatch.setattr(similar, "STAR_ROUNDS", 1)
    assert star_rounds(spark, monkeypatch, variants(1, 24)) == 1


def test_components_on_the_driver_and_in_rounds(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i + 1, i) for i in range(1000, 1040)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    local = sorted(map(tuple, similar._components(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert local == sorted(map(tuple, similar._components(df).collect())) == sorted(map(tuple, simhash.components(df).collect()))
    assert similar._components(df.limit(0)).collect() == []
    monkeypatch.undo()
    assert similar._components(df.limit(0)).collect() == []
