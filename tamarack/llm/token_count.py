"""Exact token counts of a byte-level BPE tokenizer, with a whole-token shortcut.

A text is cut into pre-tokens; BPE never merges across them. Once, on the driver, every
vocabulary string is merged on its own: those that come out as one token are proved to be whole
tokens. The proved table is sent to the workers. A pre-token in it counts one without any merging; only the rest is merged (memoized).
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, text_udf

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Bound of the per-worker memo; reaching it clears the memo, which costs time and changes nothing.
MAX_KNOWN, MAX_KEPT_CHARS = 600_000, 64
NONE = 1 << 60
#: Fixed value: the public pre-token pattern of this tokenizer family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies (by rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    spare = 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


class WholeTokens:
    """Counter for one tokenizer file; made on the driver, copied to each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE without a prefix space is supported")
        if spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"{path}: normalizers, dropout, ignored merges and byte fallback are not supported")
        self.char = byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        if any(a + b not in model["vocab"] for a, b in pairs) or any(c not in model["vocab"] for c in self.char.values()):
            raise ValueError(f"{path}: a merge or a byte has no token")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with options are not supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = added
        self.cut = regex.compile(PRE_TOKEN)
        back = {c: bytes([b]) for b, c in self.char.items()}
        self.whole = set()
        for word in model["vocab"]:
            if all(c in back for c in word) and self.merged(list(word)) == 1:  # the proof, string by string
                try:
                    text = b"".join(back[c] for c in word).decode("utf-8")
                except UnicodeDecodeError:
                    continue  # part of a character: never a pre-token of its own
                self.whole.add(text)
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.known = dict.fromkeys(self.whole, 1)

    def merged(self, symbols: list[str]) -> int:
        """Number of tokens after merging: lowest rank first, leftmost at equal rank; n log n in the length."""
        n, rank = len(symbols), self.rank
        if n < 60:
            parts, get = list(symbols), rank.get
            ranks = [get(p, NONE) for p in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) != NONE:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get((parts[i], parts[i + 1]), NONE)
                if i:
                    ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
            return len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        parts = list(symbols)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            left -= 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def _miss(self, word: str) -> int:
        char = self.char
        n = self.merged([char[b] for b in word.encode("utf-8")])
        if len(word) <= MAX_KEPT_CHARS:
            if len(self.known) >= MAX_KNOWN:
                self.known = dict.fromkeys(self.whole, 1)
            self.known[word] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; strings of added tokens inside it count as that one token."""
        if not text:
            return 0
        if self.special is not None and any(a in text for a in self.added):
            return len(self.special.findall(text)) + sum(self._plain(part) for part in self.special.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        known, miss = self.known.get, self._miss
        words = self.cut.findall(text)
        counts = list(map(known, words))
        if None in counts:
            return sum([n or known(w) or miss(w) for n, w in zip(counts, words, strict=True)])
        return sum(counts)


_COUNTERS: dict[str, WholeTokens] = {}


def counter(path: str) -> WholeTokens:
    """The tokenizer's counter; built (and its shortcut proved) once per process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WholeTokens(path)
    return _COUNTERS[path]


def _count_batch(sent):
    table = sent.value
    return lambda texts: {"n": [table.count(t) for t in texts]}


def with_token_count(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` and, as its last column, the exact number of tokens of every whole text. Null and empty texts have none.

    The column is called ``out``; where ``df`` has that name, underscores come in front. Only the driver reads the tokenizer's file.
    """
    sent = df.sparkSession.sparkContext.broadcast(counter(tokenizer_path))  # a vocabulary of fixed size
    make = text_udf(df.sparkSession, lambda: _count_batch(sent), "n long")
    return added(df, out, make(F.col(text))["n"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """op6: doc_id, n_bytes, n_tokens and over_limit of every document."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = with_token_count(docs, tokenizer_path or default_tokenizer())
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
