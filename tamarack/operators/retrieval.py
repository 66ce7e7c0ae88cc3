"""Text retrieval: TF-IDF over word 1- and 2-grams with smooth idf and L2 norm, fused with a term-hit fraction.

No table of pairs is made, neither of documents and terms nor of queries and documents:

1. Documents are dealt by key over chunks of about ``CHUNK_BYTES`` of text. A chunk counts its terms and sends a list of its
   distinct terms, as digests of ``DIGEST_BITS`` bits in order, with the number of its documents that have each.
2. The lists meet by ranges of the digests. Each range adds them up and sends every chunk its document
   frequencies back, in the order in which the terms came, so without the terms. The queries are one more such chunk.
3. Each chunk cuts its words again and now knows the exact weight of each of its terms. It scores every document
   against every query and gives on what can be among the first ``k`` of a query. The rest is one small ranking.

What is shuffled is the words of the texts twice and about a dozen bytes for each distinct term of a chunk. The queries are held whole
in every worker.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import removed, written
from tamarack.session import ship_package

#: Shares of the two scores.
COSINE, HITS = 0.68, 0.32
TOKEN = r"[\p{L}\p{N}_]+"
#: Bytes of text in a chunk of documents, and bits by which a term is known.
CHUNK_BYTES, DIGEST_BITS = 8 << 20, 80
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Number of the chunk that the queries are, scores (documents times queries) held at a time, decimals of a score.
QUERIES, SCORES, DECIMALS = -1, 1 << 17, 4


def words_of(text):
    """The lower-cased words of a text, joined by spaces; null has none."""
    return F.concat_ws(" ", F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)))


# ---------------------------------------------------------------- terms of a chunk


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(words: list[str]) -> np.ndarray:
    """(2, words) uint64: two digests of each word."""
    found = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words)
    return np.frombuffer(found, dtype="<u8").reshape(-1, 2).T


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, rising; sorting is faster here than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1]))]


def _in_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of digests."""
    order = np.argsort(high)
    return np.lexsort((low, high)) if (high[order][1:] == high[order][:-1]).any() else order


class Terms:
    """Distinct terms of some texts in the order of their digests, and what each owner has of them.

    ``owner`` numbers the documents that the texts belong to; texts of one owner add up, and no pair of words spans two texts.
    ``high`` and ``low`` are the digests; ``of``, ``term`` and ``tf`` hold one entry for each owner and term of it, by owner.
    """

    def __init__(self, texts: pa.Array, owner: np.ndarray):
        lists = pc.split_pattern(texts, " ")
        flat, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        coded = flat.dictionary_encode()
        self.words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if "" in self.words:  # a text without words is one empty piece
            empty = self.words.index("")
            del self.words[empty]
            row, code = row[code != empty], code[code != empty]
            code = code - (code > empty)
        size = len(self.words)
        after = row[1:] == row[:-1]
        pairs, term = np.unique(code[:-1][after] * size + code[1:][after], return_inverse=True)
        first, second = pairs // max(size, 1), pairs % max(size, 1)
        d = _digests(self.words)
        with np.errstate(over="ignore"):
            high = np.concatenate((d[0], _mixed(d[0][first] + _mixed(d[0][second] + np.uint64(1)))))
            low = np.concatenate((d[1], _mixed(d[1][first] + _mixed(d[1][second] + np.uint64(2)))))
        low = (low & np.uint64((1 << (DIGEST_BITS - 64)) - 1)).astype(np.uint16)
        order = _in_order(high, low)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.high, self.low = high[order], low[order]
        many = max(len(order), 1)
        both, self.tf = np.unique(np.concatenate((owner[row] * many + place[code], owner[row[:-1][after]] * many + place[size + term])), return_counts=True)
        self.of, self.term = both // many, both % many
        self.row, self.code = row, code

    def words_in(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of every distinct word of each text."""
        many = max(len(self.words), 1)
        seen = _distinct(self.row * many + self.code)
        return seen // many, seen % many

    def frequency(self) -> np.ndarray:
        """Owners of each term."""
        return np.bincount(self.term, minlength=len(self.high))


def _packed(values: np.ndarray) -> bytes:
    """Counts as one byte each; larger ones follow, in order, as eight."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype="<i8", offset=n)
    return out


def _narrow(high: np.ndarray) -> bytes:
    """Rising digests: the first one, then the steps to the next ones in six bytes each, or in eight where one needs more."""
    steps = np.diff(high).astype("<u8")
    width = 6 if not len(steps) or steps.max() < np.uint64(1 << 48) else 8
    return high[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(data, dtype=np.uint8, count=8)
    if n > 1:
        width = (len(data) - 8) // (n - 1)
        steps[1:, :width] = np.frombuffer(data, dtype=np.uint8, offset=8).reshape(n - 1, width)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


LISTS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("counts", pa.binary())])
FOUND = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])


def _lists(chunk: int, terms: Terms, counts: np.ndarray, parts: int) -> pa.Table:
    """The terms of a chunk and their counts, a row for each range of digests."""
    part = ((terms.high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(part, np.arange(parts + 1))
    rows = [(p, int(a), int(b)) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    columns = [[chunk] * len(rows), [p for p, _, _ in rows], [b - a for _, a, b in rows]]
    columns += [[_narrow(terms.high[a:b]) for _, a, b in rows], [terms.low[a:b].astype("<u2").tobytes() for _, a, b in rows], [_packed(counts[a:b]) for _, a, b in rows]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, LISTS, strict=True)], schema=LISTS)


def _added(lists: pa.Table) -> pa.Table:
    """Lists of one range in; for each of them the sums over all lists out, in the order of its terms."""
    sizes = lists["n"].to_numpy()
    high = np.concatenate([_wide(h, n) for h, n in zip(lists["high"].to_pylist(), sizes.tolist(), strict=True)])
    low = np.frombuffer(b"".join(lists["low"].to_pylist()), dtype="<u2")
    counts = np.concatenate([_unpacked(c, n) for c, n in zip(lists["counts"].to_pylist(), sizes.tolist(), strict=True)])
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    sums = np.empty(len(order), dtype=np.int64)
    sums[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    sent = [_packed(sums[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    return pa.table([lists["chunk"], lists["part"], lists["n"], pa.chunked_array([pa.array(sent, pa.binary())])], schema=FOUND)


def _frequencies(found: pa.Table) -> np.ndarray:
    """Document frequencies of a chunk's terms, in order, from its rows of FOUND."""
    found = found.sort_by("part")
    parts = [_unpacked(c, n) for c, n in zip(found["counts"].to_pylist(), found["n"].to_pylist(), strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


# ---------------------------------------------------------------- scores


class Asked:
    """The queries: weights of their terms, and what their hit fractions look for.

    ``asks`` has a row of item number and space-separated terms for each query row, each term with the words in it. A term
    that is a part of a word is found by the words of a text alone (``sure``). Of any other, the longest word in it must be found
    there (``maybe``); whether the text contains it is then looked up where that matters.
    """

    def __init__(self, terms: Terms, items: int, df: np.ndarray, n: int, asks: list[tuple[int, list[tuple[str, list[str]]]]]):
        known = df[terms.term] > 0
        of, term, tf = terms.of[known], terms.term[known], terms.tf[known]
        weight = tf * (np.log((1.0 + n) / (1.0 + df[term])) + 1.0)
        self.n, self.norms = n, np.sqrt(np.bincount(of, weight * weight, minlength=items))
        order = np.argsort(term, kind="stable")
        self.high, self.low = terms.high, terms.low
        self.start = np.searchsorted(term[order], np.arange(len(terms.high) + 1))
        self.item, self.weight = of[order], weight[order]
        self.ask_item = np.array([i for i, _ in asks], dtype=np.int64)
        self.ask_sizes = np.array([max(1, len(pieces)) for _, pieces in asks], dtype=np.float64)
        probes: dict[str, int] = {}
        self.unsure: list[list[str]] = []
        sure_at, maybe_at = [], []
        for ask, (_, pieces) in enumerate(asks):
            self.unsure.append([])
            for x, runs in pieces:
                probe = max(runs, key=len) if runs else ""
                (sure_at if probe == x else maybe_at).append((probes.setdefault(probe, len(probes)), ask))
                if probe != x:
                    self.unsure[-1].append(x)
        self.probes = probes
        self.sure, self.maybe = (np.zeros((len(probes), len(asks)), dtype=np.float32) for _ in range(2))
        for at, into in ((sure_at, self.sure), (maybe_at, self.maybe)):
            for probe, ask in at:
                into[probe, ask] += 1

    def postings(self, terms: Terms) -> np.ndarray:
        """For each term its place among the queries' terms, or -1."""
        if not len(self.high):
            return np.full(len(terms.high), -1)
        at = np.searchsorted(self.high, terms.high)
        last = len(self.high) - 1
        out = np.full(len(terms.high), -1)
        for _ in range(len(self.high)):  # terms that share the first digest lie side by side
            here = np.minimum(at, last)
            same = (at <= last) & (self.high[here] == terms.high)
            out[same & (self.low[here] == terms.low)] = at[same & (self.low[here] == terms.low)]
            at = at + 1
            if not (same & (out < 0)).any():
                break
        return out

    def probes_in(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, probe) numbers, by word, of all probes that are part of a word: a running product tells which may be, a comparison which are."""
        points = lambda xs: np.frombuffer("".join(xs).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        text, sizes = points(words), np.array([len(w) for w in words], dtype=np.int64)
        end = np.repeat(np.cumsum(sizes), sizes)
        at, product = np.arange(len(text)), np.zeros(len(text), dtype=np.uint64)
        by_size: dict[int, list[str]] = {}
        for probe in self.probes:
            by_size.setdefault(len(probe), []).append(probe)
        found = [np.empty(0, dtype=np.int64)]
        for size in range(1, max(by_size, default=0) + 1):
            inside = at + size <= end[at]
            at, product = at[inside], product[inside]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                product = product * FACTOR + text[at + size - 1]
            if size not in by_size:
                continue
            letters = points(by_size[size]).reshape(-1, size)
            products = np.zeros(len(letters), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i in range(size):
                    products = products * FACTOR + letters[:, i]
            order = np.argsort(products, kind="stable")
            low, high = (np.searchsorted(products[order], product, side) for side in ("left", "right"))
            numbers = np.array([self.probes[p] for p in by_size[size]], dtype=np.int64)
            for more in range(int((high - low).max())):
                here = np.flatnonzero(low + more < high)
                probe = order[low[here] + more]
                same = (text[at[here][:, None] + np.arange(size)] == letters[probe]).all(axis=1)
                word = np.searchsorted(np.cumsum(sizes), at[here][same], "right")
                found.append(word * len(self.probes) + numbers[probe[same]])
        both = _distinct(np.concatenate(found))
        return both // max(len(self.probes), 1), both % max(len(self.probes), 1)


def _first(scores: np.ndarray, keys: np.ndarray, k: int, sure: np.ndarray | None = None) -> np.ndarray:
    """Places of all that can be among the first ``k`` by rounded score, then key; ``sure`` are scores that are certain, ``scores`` the most they can be."""
    unit, slack = 10.0**DECIMALS, 1e-6
    least = np.floor((scores if sure is None else sure) * unit + 0.5 - slack)
    most = np.floor(scores * unit + 0.5 + slack)
    if len(scores) <= k:
        return np.arange(len(scores))
    bar = np.partition(least, len(least) - k)[len(least) - k]
    at = np.flatnonzero(least >= bar)
    last = at[np.lexsort((keys[at], -least[at]))[k - 1]]
    return np.flatnonzero((most > least[last]) | ((most == least[last]) & (keys <= keys[last])))


def _cosines(terms: Terms, df: np.ndarray, asked: Asked, owners: int):
    """(first owner, cosines) of the owners in slices; a cosine is 0 where no term is shared."""
    weight = terms.tf * (np.log((1.0 + asked.n) / (1.0 + df)) + 1.0)[terms.term]
    norms = np.sqrt(np.bincount(terms.of, weight * weight, minlength=owners))
    posting = asked.postings(terms)[terms.term]
    hit = np.flatnonzero(posting >= 0)
    of, posting, weight = terms.of[hit], posting[hit], weight[hit]
    lengths = asked.start[posting + 1] - asked.start[posting]
    items = len(asked.norms)
    step = max(1, SCORES // max(items, 1))
    for begin in range(0, owners, step):
        a, b = np.searchsorted(of, (begin, begin + step))
        count = min(step, owners - begin)
        long = lengths[a:b]
        at = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long) + np.repeat(asked.start[posting[a:b]], long)
        cell = np.repeat(of[a:b] - begin, long) * items + asked.item[at]
        dots = np.bincount(cell, asked.weight[at] * np.repeat(weight[a:b], long), minlength=count * items).reshape(count, items)
        scale = np.outer(norms[begin : begin + count], asked.norms)
        yield begin, np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)


def _owners(keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each row's key in order (null last), and the keys themselves."""
    coded = keys.dictionary_encode(null_encoding="encode")
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    order = pc.sort_indices(coded.dictionary, null_placement="at_end").to_numpy()
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) and whole.num_chunks == 1 else pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _best_cosines(terms: Terms, df: np.ndarray, asked: Asked, owners: int, named: int, k: int) -> list[tuple]:
    """(item, owner, score) that can be among the first k of an item; owners from ``named`` on have no key."""
    out = []
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0)) for _ in asked.norms]
    for begin, cosines in _cosines(terms, df, asked, owners):
        for item, (who, score) in enumerate(kept):
            new = np.flatnonzero(cosines[: max(0, named - begin), item] > 0)
            who, score = np.concatenate((who, new + begin)), np.concatenate((score, cosines[new, item]))
            best = _first(score, who, k)
            kept[item] = who[best], score[best]
    for item, (who, score) in enumerate(kept):
        out += [(item, int(w), float(s)) for w, s in zip(who, score, strict=True)]
    return out


def _whole(words: str, gaps: str) -> str:
    """The lower-cased text from its words and what stands between them, where each word is a ``_``."""
    pieces = [""] * (2 * gaps.count("_") + 1)
    pieces[::2] = gaps.split("_")
    if words:
        pieces[1::2] = words.split(" ")
    return "".join(pieces)


def _best_fused(terms: Terms, df: np.ndarray, asked: Asked, owners: int, named: int, owner: np.ndarray, words: pa.Array, gaps: pa.Array, k: int) -> list[tuple]:
    """(item, owner, score) of text rows and query rows that can be among the first k of an item; ``gaps``: what stands between the words."""
    holder, flat = asked.probes_in(terms.words)
    sizes = np.bincount(holder, minlength=len(terms.words))
    starts = np.cumsum(sizes) - sizes
    always = asked.probes.get("")
    total = asked.ask_sizes
    by_owner = np.argsort(owner, kind="stable")
    text_rank = np.empty(len(owner), dtype=np.int64)
    text_rank[by_owner] = np.arange(len(owner))
    word_of, word = terms.words_in()
    order = np.argsort(text_rank[word_of], kind="stable")
    word_rank, word = text_rank[word_of][order], word[order]
    sorted_owner = owner[by_owner]
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lows: dict[int, str] = {}  # a chunk's texts at most
    step = max(1, 16 * SCORES // max(len(asked.probes), 1))
    for begin, cosines in _cosines(terms, df, asked, owners):
        lo, hi = np.searchsorted(sorted_owner, (begin, min(begin + len(cosines), named)))
        for at in range(int(lo), int(hi), step):  # texts in the order of their owners
            rows = min(step, int(hi) - at)
            a, b = np.searchsorted(word_rank, (at, at + rows))
            long = sizes[word[a:b]]
            probe = flat[np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long) + np.repeat(starts[word[a:b]], long)]
            has = np.zeros((rows, len(asked.probes)), dtype=np.float32)
            has[np.repeat(word_rank[a:b] - at, long), probe] = 1
            if always is not None:
                has[:, always] = 1
            sure, maybe = (has @ asked.sure).astype(np.float64), (has @ asked.maybe).astype(np.float64)
            who = sorted_owner[at : at + rows]
            for ask, item in enumerate(asked.ask_item):
                cosine = cosines[who - begin, item]
                pairs = np.flatnonzero(cosine > 0)
                if not len(pairs):
                    continue
                base = COSINE * cosine[pairs]
                least, most = base + HITS * (sure[pairs, ask] / total[ask]), base + HITS * ((sure[pairs, ask] + maybe[pairs, ask]) / total[ask])
                old_own, old_score = kept.get(item, (np.empty(0, dtype=np.int64), np.empty(0)))
                cut = _first(np.concatenate((old_score, most)), np.concatenate((old_own, who[pairs])), k, np.concatenate((old_score, least)))
                stay, new = cut[cut < len(old_own)], cut[cut >= len(old_own)] - len(old_own)
                exact = least[new]
                for j, i in enumerate(new):
                    if maybe[pairs[i], ask]:
                        text = int(by_owner[at + pairs[i]])
                        if text not in lows:
                            lows[text] = _whole(words[text].as_py(), gaps[text].as_py())
                        low = lows[text]
                        exact[j] = base[i] + HITS * ((sure[pairs[i], ask] + sum(x in low for x in asked.unsure[ask])) / total[ask])
                own, score = np.concatenate((old_own[stay], who[pairs[new]])), np.concatenate((old_score[stay], exact))
                best = _first(score, own, k)
                kept[item] = own[best], score[best]
    return [(int(item), int(w), float(s)) for item, (who, score) in kept.items() for w, s in zip(who, score, strict=True)]


# ---------------------------------------------------------------- operator


def top_documents(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int, hits: bool = False) -> DataFrame:
    """(query, doc, score, rank): the ``k`` documents with the highest rounded score for each query, ties to the smaller key.

    The score is the cosine of the weights tf * (ln((1 + n) / (1 + df)) + 1), L2-normed; with ``hits`` it is fused with the share of the
    query's terms that the text contains. Only pairs that share a term have one. Texts of one key add up; rows without a key count
    in ``n`` and ``df`` and are never returned. With ``hits`` each text and each query row ranks for itself.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    dealt = docs.select(F.pmod(F.xxhash64(doc_key), F.lit(chunks)).alias("chunk"), F.col(doc_key).alias("key"), words_of(F.col("text")).alias("words"), *([F.regexp_replace(F.lower("text"), TOKEN, "_").alias("gaps")] if hits else []))

    asks = queries.where(F.col(query_key).isNotNull()).select(F.col(query_key).alias("key"), words_of(F.col("text")).alias("words"), F.transform(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""), lambda x: F.struct(x.alias("x"), F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1)).alias("runs"))).alias("pieces")).toArrow()
    ask_owner, items = _owners(_one(asks["key"]))
    ask_terms = Terms(_one(asks["words"]), ask_owner)

    def listed(table: pa.Table) -> pa.Table:
        owner, _ = _owners(_one(table["key"]))
        terms = Terms(_one(table["words"]), owner)
        return _lists(table["chunk"][0].as_py(), terms, terms.frequency(), chunks)

    schema = "chunk long, part long, n long, high binary, low binary, counts binary"
    asked_lists = spark.createDataFrame(_lists(QUERIES, ask_terms, np.zeros(len(ask_terms.high), dtype=np.int64), chunks), schema)
    lists = dealt.select("chunk", "key", "words").groupBy("chunk").applyInArrow(listed, schema).unionByName(asked_lists)
    found = written(lists.groupBy("part").applyInArrow(_added, "chunk long, part long, n long, counts binary"), "frequencies")

    df = _frequencies(found.where(F.col("chunk") == QUERIES).toArrow())
    texts = [(int(o), [(p["x"], p["runs"]) for p in ps]) for o, ps in zip(ask_owner, asks["pieces"].to_pylist(), strict=True) if ps is not None] if hits else []
    asked = spark.sparkContext.broadcast(Asked(ask_terms, len(items), df, n, texts))
    key_type, item_type = docs.schema[doc_key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()

    def scored(table: pa.Table, counts: pa.Table) -> pa.Table:
        owner, keys = _owners(_one(table["key"])) if table.num_rows else (np.empty(0, dtype=np.int64), pa.array([], table.schema.field("key").type))
        named = len(keys) - keys.null_count
        terms = Terms(_one(table["words"]), owner)
        frequencies = _frequencies(counts)
        if len(frequencies) != len(terms.high):
            raise RuntimeError("a chunk has other terms than it listed")
        if hits:
            best = _best_fused(terms, frequencies, asked.value, len(keys), named, owner, _one(table["words"]), _one(table["gaps"]), k)
        else:
            best = _best_cosines(terms, frequencies, asked.value, len(keys), named, k)
        item, doc, score = zip(*best, strict=True) if best else ((), (), ())
        return pa.table({"item": items.take(pa.array(item, pa.int64())), "doc": keys.take(pa.array(doc, pa.int64())), "score": pa.array(score, pa.float64())})

    pairs = dealt.groupBy("chunk").cogroup(found.where(F.col("chunk") != QUERIES).groupBy("chunk")).applyInArrow(scored, f"item {item_type}, doc {key_type}, score double")
    best = written(pairs, "best")
    removed(found)
    ranked = best.select(F.col("item").alias(query_key), F.col("doc").alias(doc_key), F.round("score", DECIMALS).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key))).where(f"rank <= {k}")
