"""SentencePiece (BPE with byte fallback) encoding through a merge-type prefix table.

For every prefix of a unit of text the table keeps one id: the last token of that prefix's own BPE
encoding. An Aho-Corasick automaton over the vocabulary gives all pieces that end at a position;
a piece is the prefix's last token exactly if it is compatible with the last token of the prefix
before it, that is if the two side by side encode to themselves. Exactly one piece passes at each
position, so the ids are read off backwards from the end. Pair tests are memoized.

A unit is a stretch of text that no piece can cross. Where a unit may be cut is
proved from the vocabulary when the model is loaded, not assumed.

Decoding reads the ids alone: pieces by number, runs of byte pieces as UTF-8. Nothing of the text that was encoded is kept for it.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import string
import sys
from array import array
from collections import Counter

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, kept, text_udf

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bounds of the per-worker memo tables; what falls out is made again, which costs time and changes nothing. Units are
#: kept in two generations of MAX_UNITS: when the younger one is full it becomes the older one, whose units come back when they are met.
MAX_UNITS, MAX_PAIRS, MAX_UNIT_CHARS = 150_000, 500_000, 64
BIG_ENDIAN = sys.byteorder == "big"
#: Every byte that is not part of a valid character becomes one replacement character.
EACH = "tamarack-each"
codecs.register_error(EACH, lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Vocabulary:
    """The pieces of a SentencePiece BPE model, read through the public library."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        ids = range(n)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.surface = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        self.byte_id = {int(self.surface[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.id = {self.surface[i]: i for i in ids if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        if len(self.byte_id) != 256:
            raise ValueError(f"{path} has no full byte fallback")
        if model.encode("a  b ")[:1] != model.encode("a") or model.decode(model.encode(" a ")) != " a ":
            raise ValueError(f"{path} normalizes text; only identity normalization with a dummy prefix is supported")
        # proof that units are closed: no piece holds a space mark after another character, or a line break,
        # and the punctuation that ends a unit follows no letter or digit inside any piece
        crossing = [p for p in self.id if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
        if crossing:
            raise ValueError(f"{path} has pieces across unit borders, such as {crossing[0]!r}")
        inside = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self.neighbours = inside
        self.stops = "".join(c for c in string.punctuation if not any(b == c and re.match(r"[^\W_]", a) for a, b in inside))


def merge_encode(symbols: str, score: dict[str, float]) -> list[str]:
    """BPE by definition: merge the best-scored adjacent pair, leftmost first, until none is in the vocabulary."""
    parts = list(symbols)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Spines:
    """When the outermost parts of each token are made and used up while the token is merged.

    ``right[t]`` lists (part, made at, used up at) from the whole token down to its last character,
    ``left[t]`` down to its first one. Times are merge ranks: small merges first.
    """

    def __init__(self, vocab: Vocabulary):
        order = sorted(vocab.id, key=lambda p: -vocab.score[p])
        self.rank = {p: r for r, p in enumerate(order) if len(p) > 1}
        self.vocab, self.splits, self.right, self.left = vocab, {}, {}, {}
        scores = Counter(vocab.score[p] for p in vocab.id if len(p) > 1)
        even = [p for p in vocab.id if len(p) > 1 and scores[vocab.score[p]] > 1]
        #: tokens that hold pieces of equal score: place alone orders those merges, so times do not tell
        self.even = {i for p, i in vocab.id.items() if any(q in p for q in even)}
        self.proper = [p for p in vocab.id if len(p) == 1 or self._split(p)]
        for piece in self.proper:
            i = vocab.id[piece]
            self.right[i], self.left[i] = self._spine(piece, 1), self._spine(piece, 0)

    def _split(self, piece: str) -> bool:
        """Keep the last merge of ``piece``; false if BPE does not make it whole."""
        parts = merge_encode(piece, {p: s for p, s in self._inner(piece).items() if p != piece})
        if len(parts) != 2 or merge_encode(piece, self._inner(piece)) != [piece]:
            return False
        self.splits[piece] = (parts[0], parts[1])
        return True

    def _inner(self, piece: str) -> dict[str, float]:
        n, score = len(piece), self.vocab.score
        return {q: score[q] for i in range(n) for j in range(i + 2, n + 1) if (q := piece[i:j]) in score}

    def _spine(self, piece: str, side: int) -> list[tuple[str, int, float]]:
        out, used = [], float("inf")
        while True:
            made = self.rank.get(piece, -1)
            out.append((piece, made, used))
            if piece not in self.splits:
                return out
            used, piece = made, self.splits[piece][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are their own encoding.

        They are not if some part at the end of the left one and some part at the start of the right
        one exist at the same time and can merge before either is used up. At equal rank the leftmost
        merge goes first: the left part is then gone, the right part is not.
        """
        if left in self.even or right in self.even:
            pair = [self.vocab.surface[left], self.vocab.surface[right]]
            return merge_encode("".join(pair), self.vocab.score) == pair
        rank = self.rank
        for x, x_made, x_used in self.right[left]:
            for y, y_made, y_used in self.left[right]:
                r = rank.get(x + y)
                if r is not None and (at := max(r, x_made, y_made)) < x_used and at <= y_used:
                    return False
        return True


class PrefixTable:
    """Encoder and decoder of one model; one per Python worker."""

    def __init__(self, path: str):
        self.vocab = v = Vocabulary(path)
        self.spines = Spines(v)
        self.automaton = ahocorasick.Automaton()
        for piece in self.spines.proper:  # other pieces are never a last token
            self.automaton.add_word(piece, (v.id[piece], len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.silent = {v.surface[v.bos], v.surface[v.eos]}
        self.shown = ["" if p in self.silent else p.replace(SPACE, " ") for p in v.surface]
        self.byte_of = np.full(len(v.surface), -1, dtype=np.int16)
        for b, i in v.byte_id.items():
            self.byte_of[i] = b
        stop = f"{SPACE}*[^\\W_]++(?=[{re.escape(v.stops)}])|" if v.stops else ""
        self.cut = re.compile(f"{stop}{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are their own encoding."""
        a, b = self.vocab.surface[left], self.vocab.surface[right]
        known = (a[-1], b[0]) not in self.vocab.neighbours or self.spines.compatible(left, right)
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = known
        return known

    def tokens(self, unit: str) -> list[int]:
        """Token ids of one unit; -1 where a character is in no piece."""
        last = [-1] * len(unit)
        size = [1] * len(unit)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(unit):
            if last[end] < 0:
                before = end - length
                if before >= 0 and (left := last[before]) >= 0:
                    fits = pairs.get(left << 20 | token)
                    if fits is None:
                        fits = self.compatible(left, token)
                    if not fits:
                        continue
                last[end] = token
                size[end] = length
        out, at = [], len(unit) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def unit(self, unit: str) -> bytes:
        """Ids of one unit as little-endian 32-bit integers."""
        made = self.older.get(unit)
        if made is None:
            tokens = self.tokens(unit)
            made = array("I", self._with_bytes(unit, tokens) if -1 in tokens else tokens)
            if BIG_ENDIAN:
                made.byteswap()
            made = made.tobytes()
        if len(unit) <= MAX_UNIT_CHARS:
            if len(self.units) >= MAX_UNITS:
                self.older, self.units = self.units, {}
            self.units[unit] = made
        return made

    def _with_bytes(self, unit: str, tokens: list[int]) -> list[int]:
        """``tokens`` with the UTF-8 bytes of every character that is in no piece."""
        out, at, surface, byte_id = [], 0, self.vocab.surface, self.vocab.byte_id
        for token in tokens:
            if token >= 0:
                out.append(token)
                at += len(surface[token])
            else:
                out.extend([byte_id[b] for b in unit[at].encode()])
                at += 1
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text without begin and end, little-endian 32-bit; null is empty."""
        if not text:
            return b""
        known, make = self.units.get, self.unit
        return b"".join([known(u) or make(u) for u in self.cut.findall(SPACE + text.replace(" ", SPACE))])

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids, as the library decodes them; begin and end are silent."""
        numbers = np.frombuffer(ids, dtype="<u4")
        as_bytes = self.byte_of[numbers]
        if (as_bytes < 0).all():
            text = "".join(map(self.shown.__getitem__, numbers.tolist()))
        else:  # runs of byte pieces are UTF-8 of their own
            out, is_byte = [], as_bytes >= 0
            edges = [0, *(np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1).tolist(), len(numbers)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if is_byte[start]:
                    out.append(as_bytes[start:stop].astype(np.uint8).tobytes().decode("utf-8", EACH))
                else:
                    out.extend(map(self.shown.__getitem__, numbers[start:stop].tolist()))
            text = "".join(out)
        first = next((p for p in map(self.vocab.surface.__getitem__, numbers) if p not in self.silent), "")
        return text[1:] if first.startswith(SPACE) else text  # the dummy space in front goes


def prefix_table(path: str) -> PrefixTable:
    """The model's table; built once per Python worker."""
    return kept(("sentencepiece", path), lambda: PrefixTable(path))


def _ids_batch(path: str):
    table = prefix_table(path)
    begin, end = (i.to_bytes(4, "little") for i in (table.vocab.bos, table.vocab.eos))

    def batch(texts: list) -> dict:
        ids = [begin + table.encode(text) + end for text in texts]
        return {"ids": ids, "decoded": [table.decode(i) for i in ids]}

    return batch


def _digest_batch(path: str):
    table = prefix_table(path)
    begin, end = (i.to_bytes(4, "little") for i in (table.vocab.bos, table.vocab.eos))

    def batch(texts: list) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:  # one text at a time: only digests are kept
            ids = begin + table.encode(text) + end
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
        return out

    return batch


def encode_decode(df: DataFrame, model_path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """``df`` and, last, a struct of ``ids`` (little-endian 32-bit, begin and end included) and the ``decoded`` text of these ids.

    Null and empty texts give begin and end alone and an empty text. Repeated rows are encoded alike. The
    column is called ``out``; where ``df`` has that name, underscores come in front.
    """
    make = text_udf(df.sparkSession, lambda: _ids_batch(model_path), "ids binary, decoded string")
    return added(df, out, make(F.col(text)))


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, null and empty texts included; ids themselves never leave the worker."""
    make = text_udf(df.sparkSession, lambda: _digest_batch(model_path), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return df.select(F.col(id_col).alias("doc_id"), make(F.col(text)).alias("d")).select("doc_id", "d.*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """op5: digests of every document's ids and of the text decoded from them."""
    return digests(documents(spark, sf_dir), model_path or default_model())
