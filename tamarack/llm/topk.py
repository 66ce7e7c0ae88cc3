"""Exact top-k by inner product with MaxScore.

Components become whole numbers. The terms of a query are its dimensions: the postings of a dimension in a
shard are the vectors that are not zero there, with their components as impacts, and a term's bound is the most that one of them
can add to a score. Vectors outside a list add nothing, so a bound is never below zero.

MaxScore: terms are ordered by bound. While the bounds of the smallest ones together stay below the query's
threshold, these terms are non-essential: a vector in none of the essential lists can't reach it. The essential postings
are traversed and summed; what they meet is probed in the other terms, strongest first, for as long as
score so far plus bounds left is competitive. The threshold is the k-th best score that is known: it starts from one
shard that every query is run against first, and rises over the shards that a task searches. Ties at the
threshold are kept. The lists of the tasks are merged by score and id, so the result is exact.

Vectors are packed into shards and queries into blocks, both tables in the shared folder, and every block meets every
shard. Neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.llm.common import prepare, written
from tamarack.session import table

K, SCALE = 10, 1024
#: Vectors of a shard (one posting index) and queries of a block: bounds of memory, not of the result.
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: Non-essential terms probed between two tests, and query blocks whose best lists a task holds at a time.
PROBE, HELD_BLOCKS = 8, 4
LEAST, MOST = -(2**63), 2**63 - 1
PACKED = "place long, ids binary, dims int, kind string, data binary"


class Shard:
    """Posting lists of a block of integer vectors; ``read`` counts the postings that searches have read."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns, self.read = ids, np.ascontiguousarray(vectors.T), 0
        self.highest, self.lowest = vectors.max(axis=0, initial=0), vectors.min(axis=0, initial=0)
        there = vectors != 0
        self.sizes = there.sum(axis=0)
        #: a list that holds every vector is read as a column
        self.postings = {d: np.flatnonzero(there[:, d]) for d in np.flatnonzero(self.sizes < len(ids))}

    def search(self, query_id: int, query: np.ndarray, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, positions) of at most ``k`` vectors that reach the threshold, best first, ties to the smaller id; not the query's own id."""
        n, least = len(self.ids), -np.inf if threshold is None else threshold
        bound = np.maximum(query * self.highest, query * self.lowest)  # both hold zero, so a bound does too
        asked = np.flatnonzero(query)
        order = asked[np.argsort(bound[asked], kind="stable")]
        below = np.cumsum(bound[order])
        split = int(np.searchsorted(below, least, side="left"))  # order[:split] together stay under the threshold
        rest = below[split - 1] if split else 0
        scores, met = self._traverse(order[split:], query)
        alive = np.flatnonzero(met) if rest < least and met is not None else np.arange(n)
        scores = scores[alive]
        while split:
            able = scores + below[split - 1] >= least
            if not able.all():
                alive, scores = alive[able], scores[able]
            for split in range(split - 1, max(0, split - PROBE) - 1, -1):
                scores = scores + self.columns[order[split]].take(alive) * query[order[split]]
                self.read += len(alive)
        good = (scores >= least) & (self.ids[alive] != query_id)
        alive, scores = alive[good], _in_64_bits(scores[good])
        if len(alive) > k:
            border = np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[scores >= border], scores[scores >= border]
        best = np.lexsort((alive, self.ids[alive], ~scores))[:k]
        return scores[best], alive[best]

    def _traverse(self, dims: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over the postings of ``dims``, and the vectors that were met (None: all of them)."""
        scores = np.zeros(len(self.ids), dtype=self.columns.dtype)
        met = np.zeros(len(self.ids), dtype=bool) if all(d in self.postings for d in dims) else None
        for d in dims:
            if (hit := self.postings.get(d)) is None:
                scores += self.columns[d] * query[d]
            else:
                scores[hit] += self.columns[d][hit] * query[d]
                if met is not None:
                    met[hit] = True
        self.read += int(self.sizes[dims].sum())
        return scores, met


def _in_64_bits(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(LEAST, min(MOST, int(s))) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def quantized(rows: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of vectors as whole doubles, padded with zeros to one length."""
    dims = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.floor(out * scale)


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both padded to one width, as doubles where every sum of products is exact there, else as Python integers."""
    dims = max(a.shape[1], b.shape[1])
    a, b = (np.hstack([x, np.zeros((len(x), dims - x.shape[1]))]) if x.shape[1] < dims else x.astype(np.float64) for x in (a, b))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1) < 2**53:
        return a, b
    whole = np.vectorize(int, otypes=[object])
    return whole(a), whole(b)


# ---------------------------------------------------------------- packed blocks


def _packed(place: int, ids: np.ndarray, rows: list[np.ndarray], scale: int) -> list[pa.Array]:
    vectors = quantized(rows, scale)
    top = float(np.abs(vectors).max(initial=0))
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return [pa.array([place], type=pa.int64()), pa.array([ids.astype("<i8").tobytes()], type=pa.binary()), pa.array([vectors.shape[1]], type=pa.int32()), pa.array([kind]), pa.array([vectors.astype(kind).tobytes()], type=pa.binary())]


def _unpacked(ids: bytes, dims: int, kind: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    return ids, np.frombuffer(data, dtype=kind).reshape(len(ids), dims)


def _pack(batches: Iterator[pa.RecordBatch], most: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) in; one row for each ``most`` vectors out."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    held_ids: list[int] = []
    held: list[np.ndarray] = []
    for batch in batches:
        flat, offsets = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
        offsets = offsets - offsets[0]
        for key, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            held_ids.append(key)
            held.append(np.array(flat[a:b], dtype=np.float64))
            if len(held) == most:
                yield pa.RecordBatch.from_arrays(_packed(held_ids[0], np.array(held_ids), held, scale), names=names)
                held_ids, held = [], []
    if held:
        yield pa.RecordBatch.from_arrays(_packed(held_ids[0], np.array(held_ids), held, scale), names=names)


class Best:
    """The best lists of one block of queries while a task searches its shards."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, thresholds: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.least: list[int | None] = [None if t == LEAST else int(t) for t in thresholds]
        self.lists = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in ids]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        theirs, mine = exact(vectors, self.vectors)
        shard = Shard(ids, theirs)
        for i, key in enumerate(self.ids.tolist()):
            scores, at = shard.search(key, mine[i], self.k, self.least[i])
            if len(at):
                scores, found = np.concatenate((self.lists[i][0], scores)), np.concatenate((self.lists[i][1], ids[at]))
                best = np.lexsort((found, ~scores))[: self.k]
                self.lists[i] = scores[best], found[best]
                if len(best) == self.k:
                    self.least[i] = max(int(scores[best[-1]]), LEAST if self.least[i] is None else self.least[i])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.lists]
        columns = [np.repeat(self.ids, sizes), np.concatenate([f for _, f in self.lists]), np.concatenate([s for s, _ in self.lists])]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _fields(batch: pa.RecordBatch, prefix: str) -> list[list]:
    return [batch.column(f"{prefix}_{n}").to_pylist() for n in ("ids", "dims", "kind", "data")]


def _seed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks next to one shard in; blocks with the threshold of each query out (LEAST where the shard has too few vectors)."""
    for batch in batches:
        floors = []
        for block, shard in zip(zip(*_fields(batch, "q"), strict=True), zip(*_fields(batch, "s"), strict=True), strict=True):
            ids, vectors = _unpacked(*block)
            best = Best(ids, vectors, np.full(len(ids), LEAST), k)
            best.search(*_unpacked(*shard))
            floors.append(np.array([LEAST if x is None else x for x in best.least], dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(f"q_{n}") for n in ("place", "ids", "dims", "kind", "data")), pa.array(floors, type=pa.binary())], names=["q_place", "q_ids", "q_dims", "q_kind", "q_data", "q_floor"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a block and a shard in; the best lists of every block over the shards of this task out."""
    held: dict[bytes, Best] = {}
    for batch in batches:
        floors = batch.column("q_floor").to_pylist()
        for floor, block, shard in zip(floors, zip(*_fields(batch, "q"), strict=True), zip(*_fields(batch, "s"), strict=True), strict=True):
            if block[0] not in held:
                if len(held) >= HELD_BLOCKS:
                    yield held.pop(next(iter(held))).rows()
                held[block[0]] = Best(*_unpacked(*block), np.frombuffer(floor, dtype="<i8"), k)
            held[block[0]].search(*_unpacked(*shard))
    for best in held.values():
        yield best.rows()


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products for every query row, exactly.

    Vectors that are null, or hold a null or non-finite component, take no part. Vectors of different
    lengths are compared as if padded with zeros; empty ones score 0. Repeated rows are candidates of their
    own; a query id that is repeated asks once, with its smallest vector. Rows with a null id take no part.
    Scores beyond a signed 64-bit number are cut to it before they are ranked. Other columns of ``vectors``
    are not read. Empty in, empty out.
    """
    prepare(vectors.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").where(finite)
    asking = clean.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    blocks = _named(written(asking.mapInArrow(lambda it: _pack(it, BLOCK_ROWS, scale), PACKED), "queries"), "q")
    packed = written(clean.mapInArrow(lambda it: _pack(it, SHARD_ROWS, scale), PACKED), "shards")
    shards = _named(packed, "s").drop("s_place")
    largest = F.broadcast(_named(packed.orderBy(F.desc(F.length("ids")), "place").limit(1), "s"))  # one shard: at most SHARD_ROWS vectors
    kinds = "q_place long, q_ids binary, q_dims int, q_kind string, q_data binary, q_floor binary"
    seeded = written(blocks.crossJoin(largest).mapInArrow(lambda it: _seed(it, k), kinds), "seeded")
    # a stated query set against all rows, in blocks: few wide rows on either side
    found = seeded.hint("shuffle_replicate_nl").crossJoin(shards).mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the ten best vectors for every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: c % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 10
"""
