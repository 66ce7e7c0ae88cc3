"""Near-duplicate groups by SimHash, compared with bit-sliced carry-save counters.

1. Each text becomes one 64-bit fingerprint (majority vote over XXH64 of its shingles).
2. Equal fingerprints collapse to one row first, so exact copies never meet in a comparison.
3. The 64 bits are cut into ``BLOCKS`` blocks. Fingerprints at distance ``radius`` or less agree
   on at least ``BLOCKS - radius`` of them, so every choice of that many blocks is one exact
   bucket key. No bucket is capped: its key fixes all bits but those of ``radius`` blocks,
   which bounds how many distinct fingerprints it can hold at any input size (2**22 here).
4. Buckets lie side by side in vertical bit planes, 64 fingerprints to a word. Every member is compared with
   the one ``lag`` places behind it, for all members of all buckets at once: a plane against itself, shifted.
   The differing bits of 64 such pairs a word go through carry-save adders into vertical counters, and a
   word is abandoned as soon as all of its pairs are beyond the radius or belong to different buckets.
   A bucket yields links only as stars (member -> smallest linked member), never as pairs.
5. Stars are joined to components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, prepare, removed, text_udf, written

SEED = 42
BITS = 64
RADIUS = 2
SHINGLE = 3
BLOCKS = 6
#: Shingles that vote at a time, and rows of whole buckets that lie in one set of bit planes (a larger bucket has its own set).
VOTES, PLANE_ROWS = 1 << 16, 1 << 16
#: Planes between two tests for words to abandon.
TEST_PLANES = 6
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, in order; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(g, seed) for g in grams), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes: a bit is set if it is in over half of them; zero for none."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), VOTES):
        part = hashes[at : at + VOTES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero when it has no words."""
    return majority(shingle_hashes(text, shingle))


def _fingerprint_batch(shingle: int):
    def batch(texts: list) -> dict:
        values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return {"fp": values.view(np.int64)}

    return batch


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``df`` and, as its last column, the fingerprint as a signed long. Null and empty texts give zero.

    The column is called ``out``; where ``df`` has that name, underscores come in front.
    """
    make = text_udf(df.sparkSession, lambda: _fingerprint_batch(shingle), "fp long")
    return added(df, out, make(F.col(text))["fp"])


# ---------------------------------------------------------------- bit-sliced comparison


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(BITS, words + 1) uint64: plane b, word w has bit j set if fingerprint 64 w + j has bit b; the last word is empty."""
    words = -(-len(fps) // 64) + 1
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (n, BITS)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64).reshape(BITS, words)


class Counters:
    """Vertical counters: bit i of 64 distances to a word in ``bits[i]``; ``over`` holds those beyond the radius for good.

    Planes enter through full adders (3:2): a plane waits until a second one of its weight is there, and the
    two are added to the counter together, so a carry goes up once for two planes and not once for each.
    """

    def __init__(self, over: np.ndarray, radius: int):
        self.radius, self.over = radius, over
        self.bits = [np.zeros_like(over) for _ in range(max(1, int(radius).bit_length()))]
        self.waiting: list[np.ndarray | None] = [None] * len(self.bits)

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        if level == len(self.bits):  # a carry out of the top is more than the radius
            self.over = self.over | plane
            return
        first = self.waiting[level]
        if first is None:
            self.waiting[level] = plane
            return
        self.waiting[level] = None
        odd = first ^ plane
        carry = (first & plane) | (odd & self.bits[level])
        self.bits[level] = self.bits[level] ^ odd
        self.add(carry, level + 1)

    def beyond(self) -> np.ndarray:
        """Mask of the distances that are more than the radius by now."""
        for level, plane in enumerate(self.waiting):
            if plane is not None:  # nothing to pair it with: a half adder
                self.waiting[level] = None
                carry = self.bits[level] & plane
                self.bits[level] = self.bits[level] ^ plane
                self.add(carry, level + 1)
        more, equal = np.zeros_like(self.over), np.full_like(self.over, FULL)
        for i in reversed(range(len(self.bits))):
            if (self.radius >> i) & 1:
                equal = equal & self.bits[i]
            else:
                more = more | (equal & self.bits[i])
                equal = equal & ~self.bits[i]
        self.over = self.over | more
        return self.over

    def keep(self, words: np.ndarray) -> None:
        """Go on with some words only; call after ``beyond``, when no plane waits."""
        self.over, self.bits = self.over[words], [b[words] for b in self.bits]


def close_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of members of one bucket within ``radius``, one array for each lag j - i.

    ``bucket`` numbers the buckets; the members of a bucket lie together.
    """
    n = len(fps)
    first = np.flatnonzero(bucket[1:] == bucket[:-1]) if n > 1 else np.empty(0, dtype=np.int64)
    if not len(first):
        return
    varying = int(np.bitwise_or.reduce(fps[first] ^ fps[first + 1]))  # bits that all members of a bucket share add nothing
    planes = bit_planes(fps)[[b for b in range(BITS) if (varying >> b) & 1]]
    last = planes.shape[1] - 1
    active = np.arange(n)
    for lag in range(1, n):
        active = active[active + lag < n]
        active = active[bucket[active + lag] == bucket[active]]
        if not len(active):
            return
        words, place = np.unique(active >> 6, return_inverse=True)
        flags = np.zeros(len(words) * 64, dtype=np.uint8)
        flags[place * 64 + (active & 63)] = 1
        counters = Counters(~np.packbits(flags, bitorder="little").view(np.uint64), radius)
        skip, shift = divmod(lag, 64)
        near, far = np.minimum(words + skip, last), np.minimum(words + skip + 1, last)
        for step, plane in enumerate(planes):
            behind = plane[near]
            if shift:
                behind = (behind >> np.uint64(shift)) | (plane[far] << np.uint64(64 - shift))
            counters.add(plane[words] ^ behind)
            if step % TEST_PLANES == TEST_PLANES - 1:
                live = np.flatnonzero(counters.beyond() != FULL)
                if len(live) < len(words):
                    if not len(live):
                        words = words[:0]
                        break
                    counters.keep(live)
                    words, near, far = words[live], near[live], far[live]
        if len(words):
            within = np.flatnonzero(np.unpackbits((~counters.beyond()).view(np.uint8), bitorder="little"))
            i = words[within >> 6] * 64 + (within & 63)
            yield i, i + lag


def stars(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(links, 2): every member of a bucket that is linked to others with the smallest one it is connected to there."""
    order = np.lexsort((fps, bucket))
    fps, bucket = fps[order], bucket[order]
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def flat() -> None:
        nonlocal parent
        while (parent != (up := parent[parent])).any():
            parent = up

    for i, j in close_pairs(fps, bucket, radius):
        flat()
        apart = parent[i] != parent[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    flat()
    member = np.flatnonzero(parent != np.arange(len(parent)))
    return np.stack((fps[member], fps[parent[member]]), axis=1)


# ---------------------------------------------------------------- buckets


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, width) of each block; the widths differ by one at most."""
    base, extra = divmod(BITS, blocks)
    out, at = [], 0
    for i in range(blocks):
        width = base + (i < extra)
        out.append((at, width))
        at += width
    return out


def bucket_keys(fp, radius: int = RADIUS, blocks: int = BLOCKS):
    """Array of (choice, bits) structs: one exact bucket key for every choice of blocks - radius blocks."""
    bounds = block_bounds(blocks)
    keys = []
    for choice, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << bounds[c][1]) - 1) << bounds[c][0] for c in chosen)
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(F.struct(F.lit(choice).cast("tinyint").alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, bits) in; star links of each bucket out. Buckets are closed before they are compared."""
    names = ("choice", "bits", "fp")
    held: list[list[np.ndarray]] = [[], [], []]
    rows, enough = 0, PLANE_ROWS

    def closed(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows, enough
        choice, bits, fps = (np.concatenate(h) for h in held)
        change = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
        end = len(fps) if last else int(change[-1]) if len(change) else 0  # the last bucket may go on
        starts = np.zeros(end, dtype=np.int64)
        starts[change[change < end]] = 1
        bucket = np.cumsum(starts)
        for c in np.unique(choice[:end]):  # the members of a bucket differ in the bits its choice leaves open, so choices do not mix
            mine = np.flatnonzero(choice[:end] == c)
            shared = np.bincount(bucket[mine] - bucket[mine[0]])[bucket[mine] - bucket[mine[0]]] > 1
            mine = mine[shared]
            if len(mine) and len(found := stars(fps[mine].astype(np.int64).view(np.uint64), bucket[mine], radius)):
                both = found.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
        for h, values in zip(held, (choice, bits, fps), strict=True):
            h[:] = [values[end:]]
        rows = len(fps) - end
        enough = max(PLANE_ROWS, 2 * rows)

    for batch in batches:
        for h, name in zip(held, names, strict=True):
            h.append(batch.column(name).to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= enough:
            yield from closed(False)
    if rows:
        yield from closed(True)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) stars that connect every two distinct fingerprints of column ``fp`` within ``radius``."""
    prepare(fps.sparkSession)
    keyed = fps.select(F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("k"), "fp").select("k.choice", "k.bits", "fp")
    dealt = keyed.repartition(F.col("choice"), F.col("bits")).sortWithinPartitions("choice", "bits")
    return dealt.mapInArrow(lambda it: _bucket_links(it, radius), "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), by large-star/small-star.

    Every round is a written table, and so is the smallest neighbour of each node, so that the join on a hot
    node can be split; one count per round comes back to the driver.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    previous = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "low")
        large = both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour of a node, and the node, hang on its smallest neighbour
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
        least = written(down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        small = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        removed(now, low, down, least)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == previous:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.written_path = now.written_path
            return out
        previous = state
    raise RuntimeError("components did not settle")


# ---------------------------------------------------------------- operator


def fingerprint_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint as a signed long, component id) for every row of ``df``.

    Texts whose fingerprints differ in ``radius`` bits or fewer are linked; a component is everything
    reachable. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows come back as often as they came in; a null id keeps its row and takes the smallest id
    of its component (null if there is none). Other columns of ``df`` are not read. Empty in, empty out.
    """
    rows = written(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).select("id", "fp"), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component")), "smallest")
    classes = written(rooted.join(smallest, "root").select("class_fp", "component"), "classes")
    removed(distinct, roots, smallest)
    return rows.join(classes, F.col("fp") == F.col("class_fp")).select("id", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = fingerprint_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
