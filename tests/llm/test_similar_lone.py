"""Near-duplicate search: sets with too many lone shingles are left out before any pair is made, and only those."""

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
from test_operators import similar_groups

from tamarack.llm import similar, simhash


def edited(rng, groups=40, copies=8):
    """Texts in groups of copies with a few to many edited words, some of them equal, from few words so that shingles meet by chance."""
    words = ["".join(rng.choices("abcdef", k=2)) for _ in range(12)]
    docs = [(-1, ""), (-2, None), (-3, "one two"), (-4, "ONE two"), (-5, "one two three four five six")]
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([6, 40, 120]))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs) * 7, " ".join(copy)))
    return docs


def test_groups_are_whole_with_a_count_of_lone_shingles(spark, monkeypatch):
    docs = edited(random.Random(3))
    groups = similar_groups([(d, x or "") for d, x in docs])
    assert 30 < len(set(groups.values())) < len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "FEW", 0)
    for told, spare in ((1 << 21, 5), (300, -9)):  # blocks in parts; and so few bits that many prints meet
        monkeypatch.setattr(similar, "TOLD", told)
        monkeypatch.setattr(similar, "SPARE", spare)
        assert {r["id"]: r["component"] for r in similar.near_duplicates(df).collect()} == groups
    assert similar.near_duplicates(df.limit(0)).collect() == []


def test_a_large_group_below_the_similarity_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = [word() for _ in range(70)]
    docs = [(i, " ".join(line + [word() for _ in range(30)])) for i in range(2100)]
    docs.append((5000, docs[0][1] + " more"))
    monkeypatch.setattr(similar, "COMMON", 0)  # as in a table whose sample does not tell which shingles are shared
    seen, real = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    found = similar.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["id"]: r["component"] for r in found} == {d: 0 if d == 5000 else d for d, _ in docs}
    assert sum(seen) <= 2


def test_lone_prints_are_counted_for_each_row():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) for _ in range(700)]
    nodes = [i if i < 400 else (1 << 33) + i for i in range(700)]
    batches = [pa.RecordBatch.from_pydict({"node": nodes[i:j], "text": texts[i:j]}) for i, j in pairwise([0, 130, 131, 390, 700])]
    ranges, width = 64, 40
    told = [tuple(r.values()) for b in similar._tell(iter(batches), 3, width, ranges) for r in b.to_pylist()]
    told.sort(key=lambda r: r[0])
    rows = pa.Table.from_pylist([dict(zip(("range", "block", "low", "high", "row"), r, strict=True)) for r in told])
    counted = pa.Table.from_batches(similar._count(iter(rows.to_batches(max_chunksize=50)))).sort_by("block")
    got = {n: c for b in similar._sum(iter(counted.to_batches())) for n, c in zip(b["node"].to_pylist(), b["lone"].to_pylist(), strict=True) if c}
    sets = [np.unique(simhash.shingle_hashes(x, 3) >> np.uint64(64 - width)) for x in texts]
    prints, times = np.unique(np.concatenate(sets), return_counts=True)
    lone = prints[times == 1]
    assert got == {n: k for n, s in zip(nodes, sets, strict=True) if (k := len(np.intersect1d(s, lone)))}
