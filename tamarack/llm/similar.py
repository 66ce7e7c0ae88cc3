"""Near-duplicate documents: five-word shingle sets with a Jaccard similarity of 0.8 or more.

SimHash comes first: the bit-sliced comparison of ``simhash`` proposes links between texts whose five-word
fingerprints differ in ``RADIUS`` bits or fewer, and each link is checked on the shingle sets. That closes the groups of
light edits. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, more than blocks can serve
exactly, so every similar pair that is left comes from shared rare shingles, which miss none: two sets of that
similarity share a shingle among the first fifth of each in one common order. The order puts rare
shingles first; a sample tells which are common, so it sets the work and never the result.

Before that, sets that can have no similar one go: those with more shingles that no other set has than a set of that
similarity may lack. Which shingles stand alone is told by prints of all shingles of all sets, dealt by ranges of the hash: a few
bytes a shingle, counted in numpy. Two shingles of one print pass for shared, which keeps a set and never drops one. What
is left are near copies and what shares nearly all of its text, so chance meetings of unrelated texts do not grow with the table.

Candidates pass three bounds before texts are cut again: how many bits of their parity maps differ (a bit tells whether an odd
number of a set's shingles fall on it, so each differing bit needs a shingle that only one of the sets has), what their
prefixes share, and how many shingles they have in each of ``BINS`` bins of the hash. The first is part of the join
that makes all open pairs of a bucket, so pairs that it rules out are never made.

Texts are read and marked once, into a table that also holds the rows themselves; a row is known by its place
there. They are cut again for the prints, and those of sets that are left for their prefixes and comparisons. No text is
shuffled: the places to look up are bitmaps over blocks of rows, broadcast up to some hundred million rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm import common, simhash
from tamarack.llm.common import checked_broadcast, free_name, prepare, removed, text_udf, written

SHINGLE = 5
#: The similarity as a fraction: PARTS / WHOLE. ``OVERLAP``: shared shingles of two sets are at least PARTS / OVERLAP of both sizes together.
PARTS, WHOLE = 4, 5
OVERLAP = PARTS + WHOLE
#: Bins in which the shingles of a set are counted, and words of 64 bits in its parity map.
BINS, PARITY = 128, 4
RADIUS = simhash.RADIUS
#: Rows and shingles of the sample that tells common shingles from rare ones. It sets their order, never the result.
SAMPLE, COMMON = 10_000, 200_000
#: Star rounds before all open pairs of a bucket are compared; members from which a bucket is large, and open pairs of large buckets for each row
#: from which star rounds pay. They set the work and never the result.
STAR_ROUNDS, LARGE, DENSE = 6, 64, 4
#: Rows of a block are those whose places differ in the last BLOCK bits only. Low bits of a print that are stored as they are; bits of a print beyond those
#: that number all shingles; shingles that meet in one range of prints; least ranges; shingles of a block that are told at a time.
BLOCK, LOW, SPARE, RANGE, RANGES, TOLD = 8, 16, 5, 1 << 21, 64, 1 << 21
#: Sets up to which prefixes are compared without a count of lone shingles, which costs more there than it saves. It sets the work and never the result.
FEW = 2_000


# ---------------------------------------------------------------- shingle sets


def prefix_size(n: int) -> int:
    """Shingles of a set of ``n`` of which a similar set shares at least one, in any common order."""
    return n + (-n * PARTS // WHOLE) + 1


def _parity(found: np.ndarray) -> np.ndarray:
    """The parity map of a set of hashes: a bit of PARITY words is set if an odd number of them fall on it."""
    bits = np.bincount((found % np.uint64(PARITY * 64)).astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _mark_batch(shingle: int):
    def batch(texts: list) -> dict:
        out: dict[str, list] = {"fp": [], "n": [], "sim": [], "bins": [], "parity": []}
        for text in texts:
            hashes = simhash.shingle_hashes(text, shingle)
            found = np.unique(hashes)
            n = len(found)
            out["sim"].append(int(np.uint64(simhash.majority(hashes)).view(np.int64)))
            out["fp"].append(int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)).view(np.int64)) if n else 0)
            out["n"].append(n)
            out["bins"].append(np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=BINS) if n else [])
            out["parity"].append(_parity(found))
        return out

    return batch


def _prefix_batch(shingle: int, order):
    def batch(texts: list) -> dict:
        known, counts = order.value
        out = []
        for text in texts:
            found = np.unique(simhash.shingle_hashes(text, shingle))
            rank = np.zeros(len(found), dtype=np.int64)
            if len(known) and len(found):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                rank = np.where(known[at] == found, counts[at], 0)
            out.append(found[np.lexsort((found, rank))[: prefix_size(len(found))]].view(np.int64))
        return {"prefix": out}

    return batch


def _set_batch(shingle: int):
    return lambda texts: {"shingles": [np.unique(simhash.shingle_hashes(t, shingle)).view(np.int64) for t in texts]}


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text): the sorted set of each whole text."""
    make = text_udf(texts.sparkSession, lambda: _set_batch(shingle), "shingles array<long>")
    return texts.select("node", make(F.col("text"))["shingles"].alias("shingles"))


def _common_shingles(texts: DataFrame, shingle: int):
    """Broadcast (hashes, counts) of the commonest shingles of a sample: at most COMMON."""
    total = texts.count()
    some = texts.sample(SAMPLE / total, simhash.SEED) if total > SAMPLE else texts
    counted = _sets(some.select(F.lit(0).alias("node"), "text"), shingle).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    top = counted.where("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()  # at most COMMON rows
    hashes, counts = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    by = np.argsort(hashes)
    return texts.sparkSession.sparkContext.broadcast((hashes[by], counts[by]))


# ---------------------------------------------------------------- candidates


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``node`` is in the table ``keys``: looked up in a bitmap of each block, so that ``rows`` need not move."""
    words = 1 << BLOCK - 6
    word = lambda i: F.expr(f"bit_or(if((node >> 6) & {words - 1} = {i}, shiftleft(1L, cast(node & 63 as int)), 0L))")
    blocks = written(keys.groupBy(F.expr(f"node >> {BLOCK}").alias("block")).agg(F.array(*map(word, range(words))).alias("bits")), "blocks")
    met = rows.join(checked_broadcast(blocks), F.expr(f"node >> {BLOCK}") == F.col("block"))
    return met.where(f"shiftright(bits[cast((node >> 6) & {words - 1} as int)], cast(node & 63 as int)) & 1 = 1").select(*rows.columns)


# ---------------------------------------------------------------- lone shingles


def _tell(batches: Iterator[pa.RecordBatch], shingle: int, width: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) in; (range, block, low, high, row) out: the sorted prints of a block's shingles in each range of prints.

    A print is the first ``width`` bits of a hash. Its last LOW bits are stored as they are and its cell (the bits
    before) in unary, counted from the start of the range; ``row`` is the place of the print's text in its block.
    """
    cells = (1 << width - LOW) // ranges
    block, held, sizes, rows, told = None, [], [], [], 0

    def closed() -> pa.RecordBatch:
        prints = np.concatenate(held) >> np.uint64(64 - width)
        both = np.sort(prints << np.uint64(BLOCK) | np.repeat(np.array(rows, dtype=np.uint64), sizes))
        row, low = both.astype(np.uint8), (both >> np.uint64(BLOCK)).astype("<u2")
        cell = (both >> np.uint64(BLOCK + LOW)).astype(np.int64)
        cut = np.searchsorted(cell, np.arange(ranges + 1) * cells)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        out: list[list] = [[], [], []]
        for r in full.tolist():
            part = slice(cut[r], cut[r + 1])
            unary = np.zeros(cells + cut[r + 1] - cut[r], dtype=np.uint8)
            unary[cell[part] - r * cells + np.arange(cut[r + 1] - cut[r])] = 1
            for column, value in zip(out, (low[part], np.packbits(unary, bitorder="little"), row[part]), strict=True):
                column.append(value.tobytes())
        columns = [pa.array(full), pa.array([block] * len(full), type=pa.int64()), *(pa.array(c, type=pa.binary()) for c in out)]
        return pa.RecordBatch.from_arrays(columns, names=["range", "block", "low", "high", "row"])

    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
            if told and (node >> BLOCK != block or told >= TOLD):
                yield closed()
                held, sizes, rows, told = [], [], [], 0
            found = np.unique(simhash.shingle_hashes(text.as_py(), shingle))
            block, told = node >> BLOCK, told + len(found)
            held.append(found)
            sizes.append(len(found))
            rows.append(node & (1 << BLOCK) - 1)
    if told:
        yield closed()


def _lone_in(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, lone): of the told ``parts`` (block, low, high, row) of one range, how many prints no other set has, for each row of each block."""
    low = [np.frombuffer(p[1], dtype="<u2") for p in parts]
    high = [np.flatnonzero(np.unpackbits(np.frombuffer(p[2], dtype=np.uint8), bitorder="little")) - np.arange(len(x)) for p, x in zip(parts, low, strict=True)]
    prints = np.concatenate(high) << LOW | np.concatenate(low)
    blocks, part = np.unique([p[0] for p in parts], return_inverse=True)
    at = np.repeat(part << BLOCK, [len(x) for x in low]) + np.frombuffer(b"".join(p[3] for p in parts), dtype=np.uint8)
    by = np.argsort(prints)
    changes = np.concatenate(([True], prints[by[1:]] != prints[by[:-1]], [True]))
    lone = by[changes[1:] & changes[:-1]]
    return blocks, np.bincount(at[lone], minlength=len(blocks) << BLOCK).reshape(-1, 1 << BLOCK)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_tell`` sorted by range in; (block, lone) out: the lone prints of each of a block's rows, as 16 bits (more count as the most)."""
    names = ("block", "low", "high", "row")
    sums: dict[int, np.ndarray] = {}
    at, parts = None, []

    def closed() -> None:
        for block, lone in zip(*_lone_in(parts), strict=True):
            sums[block] = np.minimum(sums.get(block, 0) + lone, 0xFFFF).astype("<u2")
        parts.clear()

    for batch in batches:
        for r, *part in zip(batch.column("range").to_pylist(), *(batch.column(n).to_pylist() for n in names), strict=True):
            if parts and r != at:
                closed()
            at = r
            parts.append(part)
    if parts:
        closed()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int64()), pa.array([x.tobytes() for x in sums.values()], type=pa.binary())], names=["block", "lone"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_count`` sorted by block in; (node, lone) out for all places of the blocks."""
    block, total = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((block << BLOCK) + np.arange(1 << BLOCK)), pa.array(total)], names=["node", "lone"])

    for batch in batches:
        for b, lone in zip(batch.column("block").to_pylist(), batch.column("lone").to_pylist(), strict=True):
            if total is not None and b != block:
                yield closed()
                total = None
            block, total = b, np.frombuffer(lone, dtype="<u2").astype(np.int64) + (0 if total is None else total)
    if total is not None:
        yield closed()


def _open(marked: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """The rows of ``reps`` that may have a similar set: those with fewer lone shingles than a prefix has."""
    sets, total = reps.agg(F.count("*"), F.sum("n")).first()
    if sets <= FEW or not total:
        return reps
    prepare(reps.sparkSession)
    ranges = max(RANGES, 1 << (total // RANGE).bit_length())
    width = max(LOW + ranges.bit_length(), min(64 - BLOCK, int(total).bit_length() + SPARE))
    told = _only(marked.select("node", "text"), reps).mapInArrow(lambda it: _tell(it, shingle, width, ranges), "range long, block long, low binary, high binary, row binary")
    counted = told.repartition("range").sortWithinPartitions("range").mapInArrow(_count, "block long, lone binary")
    lone = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_sum, "node long, lone long")
    lone = written(lone.withColumnRenamed("node", "place"), "lone")
    kept = reps.join(lone, F.col("node") == F.col("place"), "left").where(f"n > 0 and coalesce(lone, 0) <= n * {WHOLE - PARTS} div {WHOLE}")
    out = written(kept.select(*reps.columns), "open")
    removed(lone)
    return out


# ---------------------------------------------------------------- pairs


def _simhash_pairs(reps: DataFrame) -> DataFrame:
    """(a, b) candidates: sets of one fingerprint hang on the first of them, first ones on those within the radius."""
    heads = written(reps.where("n > 0").groupBy("sim").agg(F.min("node").alias("head")), "heads")
    same = reps.where("n > 0").join(heads, "sim").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = simhash.links(heads.select(F.col("sim").alias("fp")), RADIUS)
    one, two = heads.select(F.col("sim").alias("a"), F.col("head").alias("ha")), heads.select(F.col("sim").alias("b"), F.col("head").alias("hb"))
    out = written(same.union(near.join(one, "a").join(two, "b").select("ha", "hb")).distinct(), "pairs")
    removed(heads)
    return out


def _buckets(marked: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(h, node, n, pos): the sets that share a prefix shingle with another one."""
    mine = _only(marked.select("node", "text", "n"), reps)
    order = _common_shingles(mine.select("text"), shingle)
    make = text_udf(marked.sparkSession, lambda: _prefix_batch(shingle, order), "prefix array<long>")
    cut = mine.select("node", "n", make(F.col("text"))["prefix"].alias("prefix"))
    places = cut.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = places.withColumn("members", F.count("*").over(Window.partitionBy("h"))).where("members > 1")
    return written(shared.select("h", "node", "n", "pos"), "buckets")


SIZES = f"{WHOLE} * least(l.n, r.n) >= {PARTS} * greatest(l.n, r.n)"


def _star_pairs(state: DataFrame, turn: int) -> DataFrame:
    """(a, b) open pairs of every member of a bucket with one member of it, another one each turn."""
    centre = state.groupBy("h").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "pos", "root")).alias("c"))
    centre = written(centre.select("h", "c.node", "c.n", "c.pos", "c.root"), "centres")
    met = state.alias("l").join(centre.alias("r"), F.col("l.h") == F.col("r.h")).where(f"l.root <> r.root and {SIZES}")
    out = _able(met)
    removed(centre)
    return out


#: Sets of the similarity differ in at most so many shingles, and in a differing bit of their parity maps they differ in at least one.
APART = " + ".join(f"bit_count(l.p{i} ^ r.p{i})" for i in range(PARITY))
PARITIES = f"{OVERLAP} * ({APART}) <= {OVERLAP - 2 * PARTS} * (l.n + r.n)"


def _every_pair(state: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) of all open pairs whose parity maps allow the similarity."""
    parities = checked_broadcast(reps.select(F.col("node").alias("member"), *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY))))
    known = state.join(parities, F.col("node") == F.col("member")).drop("member")
    return _able(known.alias("l").join(known.alias("r"), F.col("l.h") == F.col("r.h")).where(f"l.node > r.node and l.root <> r.root and {SIZES} and {PARITIES}"))


def _able(met: DataFrame) -> DataFrame:
    """(a, b) of the pairs in ``met`` (sides l and r, a row for each shared prefix shingle) whose prefixes allow the similarity.

    What two sets share is in both prefixes, or in the rest of the one whose prefix ends first: so their
    shared prefix shingles and the longer rest together bound it from above.
    """
    sized = met.groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b")).agg(F.count("*").alias("c"), F.min(F.struct("l.pos", F.col("r.pos").alias("other"))).alias("first"), F.min("l.n").alias("na"), F.min("r.n").alias("nb"))
    rest = lambda n: F.floor(F.col(n) * PARTS / WHOLE) - F.when(F.col(n) * PARTS % WHOLE == 0, 1).otherwise(0)  # noqa: E731  n less its prefix
    most = F.least(F.col("c") + F.greatest(rest("na"), rest("nb")), F.col("na") - F.col("first.pos"), F.col("nb") - F.col("first.other"))
    return written(sized.where(OVERLAP * most >= PARTS * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")


def _binned(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose counts in the bins allow the similarity: they share at most the smaller count of each bin."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    bins = written(_only(marked.select("node", "n", "bins"), wanted), "bins")
    one, two = (bins.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    least = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    out = written(pairs.join(one, "a").join(two, "b").where(OVERLAP * least >= PARTS * (F.col("na") + F.col("nb"))).select("a", "b"), "binned")
    removed(pairs, wanted, bins)
    return out


def _similar(pairs: DataFrame, marked: DataFrame, shingle: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar, compared exactly. Only the texts of pairs that their bins allow are cut again."""
    pairs = _binned(pairs, marked)
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = written(_sets(_only(marked.select("node", "text"), wanted), shingle), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    found = written(sized.where(f"{OVERLAP} * common >= {PARTS} * sum").select("a", "b"), "similar")
    removed(pairs, wanted, sets)
    return found


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) of ``edges`` (a, b), as ``simhash.components``; up to BROADCAST_KEYS edges are joined on the driver, without its rounds of jobs."""
    if edges.count() > common.BROADCAST_KEYS:
        return simhash.components(edges)
    table = edges.select("a", "b").where("a <> b").toArrow()
    ends = np.concatenate((table["a"].to_numpy(), table["b"].to_numpy())).astype(np.int64)
    nodes, place = np.unique(ends, return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), place.reshape(2, -1)
    while (apart := root[a] != root[b]).any():
        one, two = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root != (up := root[root])).any():
            root = up
    moved = root != np.arange(len(nodes))
    found = pa.table({"node": nodes[moved], "root": nodes[root[moved]]})
    return written(edges.sparkSession.createDataFrame(found, "node long, root long"), "roots")


def _roots(marked: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of the sets that are joined by similarity.

    Only sets that may have a similar one take part. After the links of the fingerprints, pairs of one component need no comparison. While the open pairs
    of large buckets outnumber the rows by far, each bucket first compares its members with one of them, another one each
    round; a large group of near copies closes in these. Then every pair still open is compared. In smaller buckets a row has
    few partners, so that a round costs more than comparing them.
    """
    every_set, reps = reps, _open(marked, reps, shingle)
    found = _similar(_simhash_pairs(reps), marked, shingle)
    roots = _components(found)
    removed(found)
    buckets = _buckets(marked, reps, shingle)
    rows = buckets.count()
    for turn in range(STAR_ROUNDS + 1):
        joined = buckets.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
        state = written(joined.select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root")), "state")
        sizes = state.groupBy("h", "root").agg(F.count("*").cast("double").alias("m")).groupBy("h").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
        pairs = (F.col("m") * F.col("m") - F.col("own")) / 2
        still, large = (x or 0 for x in sizes.agg(F.sum(pairs), F.sum(F.when(F.col("m") > LARGE, pairs))).first())
        every = large <= DENSE * rows or turn == STAR_ROUNDS
        if still:
            found = _similar(_every_pair(state, reps) if every else _star_pairs(state, turn), marked, shingle)
            after = _components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
            removed(found, roots)
            roots = after
        removed(state)
        if every or not still:
            break
    removed(buckets, reps if reps is not every_set else None)
    return roots


# ---------------------------------------------------------------- operator


def _marked(df: DataFrame, text: str, shingle: int) -> tuple[DataFrame, str, str]:
    """``df`` as a written table with the place of each row and the marks of its text; and the names of these two columns."""
    place, mark = free_name(df, "place"), free_name(df, "mark")
    make = text_udf(df.sparkSession, lambda: _mark_batch(shingle), "fp long, n int, sim long, bins array<int>, parity array<long>")
    return written(df.select("*", F.monotonically_increasing_id().alias(place), make(F.col(text)).alias(mark)), "marked"), place, mark


def _classes(table: DataFrame, text: str, place: str, mark: str, shingle: int) -> DataFrame:
    """(fp, root) written: the component of every shingle set of the marked table. The first row of a set stands for it."""
    marked = table.select(F.col(place).alias("node"), F.col(text).alias("text"), f"{mark}.*")
    first = marked.groupBy("fp").agg(F.min_by(F.struct("node", "n", "sim", "parity"), "node").alias("first"))
    reps = written(first.select("fp", "first.*"), "reps")
    roots = _roots(marked, reps, shingle)
    joined = reps.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    classes = written(joined.select("fp", F.coalesce("root", "node").alias("root")), "classes")
    removed(reps, roots)
    return classes


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, digest of the shingle set, component id) for every row of ``df``.

    Texts whose sets of ``shingle``-word shingles have a similarity of PARTS / WHOLE or more are linked; a component is
    everything reachable. Null and empty texts have the empty set (digest zero) and are one component. Repeated rows come
    back as often as they came in; a null id keeps its row and takes the smallest id of its component (null if there
    is none). Empty in, empty out.
    """
    table, place, mark = _marked(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle)
    classes = _classes(table, "text", place, mark, shingle)
    rows = table.select("id", F.col(f"{mark}.fp").alias("fp"))
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first_id")).join(classes, "fp")
    smallest = firsts.groupBy("root").agg(F.min("first_id").alias("component"))
    named = written(classes.join(smallest, "root").select(F.col("fp").alias("class_fp"), "component"), "named")
    return rows.join(named, F.col("fp") == F.col("class_fp")).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row for each near-duplicate group: the one with the smallest id.

    Of rows of one group with the same id, the one with the smallest hash of its text stays, and the first of
    repeated rows; rows of one id in different groups all stay. A row with a null id stays only where its whole
    group has none. All columns are kept as they are, whatever their names. Empty in, empty out.
    """
    table, place, mark = _marked(docs, text, shingle)
    classes = _classes(table, text, place, mark, shingle)
    rows = table.select(F.col(place).alias("place"), F.col(id_col).alias("id"), F.xxhash64(text).alias("order"), F.col(f"{mark}.fp").alias("fp"))
    grouped = rows.join(classes.withColumnRenamed("fp", "class_fp"), F.col("fp") == F.col("class_fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "order", "place")).alias("first")
    kept = written(grouped.groupBy("root").agg(first).select(F.col("first.place").alias("kept")), "kept")
    gone = written(rows.join(kept, F.col("place") == F.col("kept"), "left_anti").select(F.col("place").alias(place)), "gone")
    removed(classes, kept)
    return table.join(checked_broadcast(gone), place, "left_anti").select(*docs.columns)
