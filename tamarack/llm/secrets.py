"""Secrets: base patterns, and a linear-chain conditional random field that adds what they miss.

The chain runs over all tokens of a text. A token that a secret could look like (12 or more characters of
its alphabet with a digit, or 40 of mixed case) is a node of its own; the words between two of these can only be outside, so a run of them
is one node that is observed as outside, which is the same chain with its constant factors left out. Nodes are tagged begin,
inside or outside of a secret by their shape, the words before and after them and features of the whole
text, and decoded by Viterbi.

The field is trained on lines made by rule (``planted``), once, on the driver; the workers get its weights.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, text_udf
from tamarack.llm.crf import PairwiseCRF, viterbi

KINDS = ("assign", "access", "hex")
ADDED = "secret"
ORDER = {k: i for i, k in enumerate((*KINDS, ADDED))}
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
WINDOW = 32

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
_BEFORE = re.compile(r"([A-Za-z_]+)[^A-Za-z0-9]*$")
_AFTER = re.compile(r"[^A-Za-z0-9]*([A-Za-z_]+)")
_PREFIX = re.compile(r"[A-Za-z]{2,8}[_-](?:[A-Za-z]{2,8}[_-])?(?=[A-Za-z0-9]{16})")
_NAME = re.compile(r"[A-Za-z_.-]+=(?=[A-Za-z0-9+/_.=-]{12})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CHANGE = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])")
_ANY_WORD = re.compile(r"\w")
#: Words that announce a credential.
CUES = frozenset("key apikey api_key token secret password passwd pwd auth bearer credential credentials authorization signature private".split())
#: The first one is the observed node.
FEATURES = ["plain", "base", "len12_19", "len20_39", "len40", "hex", "upper_hex", "upper_digit", "mixed_digit", "no_digit", "symbols", "dotted", "three_parts", "prefix", "uuid", "restless", "path", "url", "few_letters", "number", "cue_before", "cue_after", "separator", "quoted", "follows", "file_base", "file_key_block", "file_assignments", "bias"]
_F = {name: i for i, name in enumerate(FEATURES)}

Span = tuple[int, int, str]
Node = tuple[int, int, list[int]]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(name in low for name in _NAMES):
            out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if len(out) > 1:
        out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


# ---------------------------------------------------------------- the field


def _shape(token: str) -> list[int] | None:
    """Features of a token's shape; None if no secret looks like it."""
    digits = sum(c.isdigit() for c in token)
    upper = sum(c.isupper() for c in token)
    lower = sum(c.islower() for c in token)
    if not digits and not (upper and lower and len(token) >= 40):
        return None
    n = len(token)
    f = [_F["len12_19" if n < 20 else "len20_39" if n < 40 else "len40"]]
    if not digits:
        f.append(_F["no_digit"])
    if not upper and not lower:
        f.append(_F["number"])
    elif digits and not upper and not set(token) - set("0123456789abcdef"):
        f.append(_F["hex"])
    elif digits and not lower and n >= 32 and not set(token) - set("0123456789ABCDEF"):
        f.append(_F["upper_hex"])
    elif digits and upper and not lower:
        f.append(_F["upper_digit"])
    elif digits and upper and lower:
        f.append(_F["mixed_digit"])
    if any(c in "+/=_-" for c in token):
        f.append(_F["symbols"])
    if "." in token:
        f.append(_F["dotted"])
        if token.count(".") == 2 and min(map(len, token.split("."))) >= 8:
            f.append(_F["three_parts"])
    if _PREFIX.match(token):
        f.append(_F["prefix"])
    if _UUID.fullmatch(token):
        f.append(_F["uuid"])
    if "/" in token and all(part.isalnum() and (part.isalpha() or part.isdigit()) for part in re.split("[/._-]", token) if part):
        f.append(_F["path"])
    if len(_CHANGE.findall(token)) * 5 >= n:
        f.append(_F["restless"])
    if len(set(token)) * 2 <= min(n, 24):
        f.append(_F["few_letters"])
    return f


def chain_of(text: str, base: list[Span]) -> list[Node]:
    """(start, end, features) of the nodes by place: tokens that may belong to a secret and the runs of words between; none without such tokens."""
    tokens = []
    for m in _TOKEN.finditer(text):
        name = _NAME.match(m[0])  # in name=value the name is a word before the token
        value = m[0][name.end() if name else 0 :].rstrip(".")
        if (shape := _shape(value)) is not None:
            s = m.start() + (name.end() if name else 0)
            tokens.append((s, s + len(value), shape))
    if not tokens:
        return []
    whole = [_F["bias"]]
    if base:
        whole.append(_F["file_base"])
    if "PRIVATE KEY" in text:
        whole.append(_F["file_key_block"])
    if text.count("=") * 40 > len(text):
        whole.append(_F["file_assignments"])
    out: list[Node] = []
    i = at = 0
    for s, e, shape in tokens:
        if _ANY_WORD.search(text, at, s):
            out.append((at, s, [_F["plain"]]))
        while i < len(base) and base[i][1] <= s:
            i += 1
        f = shape + whole
        if i < len(base) and base[i][0] < e:
            f.append(_F["base"])
        before, after = text[max(0, s - WINDOW) : s], text[e : e + WINDOW]
        if (w := _BEFORE.search(before)) and w[1].lower() in CUES:
            f.append(_F["cue_before"])
        if (w := _AFTER.match(after)) and w[1].lower() in CUES:
            f.append(_F["cue_after"])
        if before.rstrip(" \"'").endswith((":", "=")):
            f.append(_F["separator"])
        if before.endswith(("'", '"')):
            f.append(_F["quoted"])
        if "://" in before[-12:] or before.endswith(("@", "/", "#", "?")) or after.startswith(("@", "://")):
            f.append(_F["url"])
        if out and out[-1][1] == at and s - at <= 2 and not text[at:s].strip():
            f.append(_F["follows"])
        out.append((s, e, f))
        at = e
    if _ANY_WORD.search(text, at):
        out.append((at, len(text), [_F["plain"]]))
    return out


def _features(chain: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of a chain and its observed labels (-1: none)."""
    x, fixed = np.zeros((len(chain), len(FEATURES))), np.full(len(chain), -1)
    for i, (_, _, f) in enumerate(chain):
        x[i, f] = 1
        if f[0] == _F["plain"]:
            fixed[i] = OUTSIDE
    return x, fixed


# ---------------------------------------------------------------- training texts

#: Alphabets, prefixes and words of the training lines; tests score the field on other ones.
TRAINING = {"prefixes": ("ghp_", "sk-", "sk_live_", "pat-"), "cues": ("auth", "credential", "key", "bearer"), "letters": "abcdefghijklmnopqrstuvwxyz", "hosts": ("www", "docs", "img")}


def planted(rng: random.Random, names: dict = TRAINING) -> tuple[str, list[tuple[int, int]]]:
    """A text made by rule, and the places of its secrets: what the base patterns find, and forms that they miss.

    Missed forms: credentials after a cue without a name the patterns know, prefixed keys, signed three-part
    tokens, upper-case hexadecimal keys and blocks of key lines. Between them stand mail and web addresses, paths, dates, numbers,
    serial numbers, universal ids and ruled lines, which are no secrets.
    """
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    lower, digit = names["letters"], "0123456789"
    upper = lower.upper()
    mixed = lower + upper + digit
    random_key = lambda lo, hi: pick(mixed, rng.randint(lo, hi)) + pick(digit, 2) + pick(mixed, 4)
    words = lambda: " ".join(pick(lower, rng.randint(2, 9)) for _ in range(rng.randint(1, 8)))
    text, marks = "", []

    def put(piece: str) -> None:
        nonlocal text
        marks.append((len(text), len(text) + len(piece)))
        text += piece

    for _ in range(rng.randint(1, 5)):
        text += words() + " "
        kind = rng.random()
        if kind < 0.1:
            text += f"{rng.choice(('password', 'token', 'api_key'))} = \""
            put(pick("0123456789abcdef", 40))
            text += '"'
        elif kind < 0.22:
            text += f"{rng.choice(names['cues'])}{rng.choice((': ', '=', ' '))}"
            put(random_key(18, 40))
        elif kind < 0.3:
            put(rng.choice(names["prefixes"]) + random_key(20, 36))
        elif kind < 0.36:
            put(".".join(random_key(lo, hi) for lo, hi in ((14, 20), (20, 60), (20, 36))))
        elif kind < 0.42:
            put(pick("0123456789ABCDEF", rng.choice((32, 40, 64))))
        elif kind < 0.5:
            text += "-----BEGIN PRIVATE KEY-----\n"
            start = len(text)
            for _ in range(rng.randint(2, 5)):
                text += pick(mixed + "+/", 58) + pick(digit, 1) + pick(mixed, 5) + "\n"
            marks.append((start, len(text) - 1))
        elif kind < 0.56:
            put(pick("0123456789abcdef", 36))
        elif kind < 0.64:
            text += f"user.{pick(digit, 2)}@mail{pick(digit, 1)}.example.com"
        elif kind < 0.74:
            text += f"http://{rng.choice(names['hosts'])}.{pick(lower, 8)}.com/{pick(lower, 6)}/{pick(digit, 4)}/{pick(lower, 9)}-{pick(digit, 3)}"
        elif kind < 0.8:
            text += rng.choice((pick(digit, rng.randint(12, 20)), f"{pick(digit, 8)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 12)}"))
        elif kind < 0.94:
            text += rng.choice((f"{pick(digit, 4)}-{pick(digit, 2)}-{pick(digit, 2)}T{pick(digit, 6)}", f"{pick(lower, 9)}-{pick(digit, 3)}", f"{pick(upper, 3)}-{pick(digit, 9)}", pick(lower, 10) + pick(digit, 2), f"{pick(digit, 3)}.{pick(digit, 3)}.{pick(digit, 2)}.{pick(digit, 3)}", f"/{pick(lower, 4)}/{pick(lower, 7)}/{pick(lower, 5)}{pick(digit, 1)}", f"{pick(lower, 6)}_{pick(lower, 5)}_{pick(digit, 3)}", f"{pick(upper, 1)}{pick(lower, 8)}{pick(upper, 1)}{pick(lower, 6)}{pick(digit, 1)}"))
        else:
            text += "=" * 20 + "1" * rng.randint(1, 3)
        text += rng.choice((" ", ".\n", ", "))
    return text, marks


def trained(seed: int = 5, texts: int = 700) -> PairwiseCRF:
    """The field, trained on ``planted`` lines; the same every time."""
    rng = random.Random(seed)
    xs, known, gold, edges = [], [], [], []
    for _ in range(texts):
        text, marks = planted(rng)
        chain = chain_of(text, base_spans(text))
        x, fixed = _features(chain)
        edges += [(len(gold) + i - 1, len(gold) + i) for i in range(1, len(chain))]
        xs.append(x)
        known.append(fixed)
        opened = set()
        for s, e, _ in chain:
            mark = next((m for m in marks if s >= m[0] and e <= m[1]), None)
            gold.append(OUTSIDE if mark is None else INSIDE if mark in opened else BEGIN)
            opened.add(mark)
    model = PairwiseCRF(len(FEATURES), 3, 1)
    pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
    model.fit(np.concatenate(xs), np.array(gold), pairs, np.zeros(len(pairs), dtype=np.int64), np.concatenate(known))
    return model


_MODEL: list[PairwiseCRF] = []


def model() -> PairwiseCRF:
    """The trained field; once per process."""
    if not _MODEL:
        _MODEL.append(trained())
    return _MODEL[0]


def tags(chain: list[Node], field: PairwiseCRF) -> list[int]:
    """Best tag of every node: Viterbi over the whole chain; inside never follows outside and never comes first."""
    scores = field.node_scores(*_features(chain))
    moves = field.pair[0].copy()
    moves[OUTSIDE, INSIDE] = -1e9
    scores[0, INSIDE] = -1e9
    return viterbi(scores, moves)


def added_spans(text: str, base: list[Span], field: PairwiseCRF) -> list[Span]:
    """Secrets that the field finds and no base span touches."""
    chain = chain_of(text, base)
    if not chain:
        return []
    spans: list[list[int]] = []
    for (s, e, _), tag in zip(chain, tags(chain, field), strict=True):
        if tag == BEGIN:
            spans.append([s, e])
        elif tag == INSIDE:
            spans[-1][1] = e
    out, i = [], 0
    for s, e in spans:
        while i < len(base) and base[i][1] <= s:
            i += 1
        if not (i < len(base) and base[i][0] < e):
            out.append((s, e, ADDED))
    return out


# ---------------------------------------------------------------- operator


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, e, k in spans])


def _span_batch(field: PairwiseCRF):
    def batch(texts: list) -> dict:
        texts = [t or "" for t in texts]
        bases = [base_spans(t) for t in texts]
        every = []
        for t, b in zip(texts, bases, strict=True):
            more = added_spans(t, b, field)
            every.append(sorted(b + more, key=lambda s: (s[0], ORDER[s[2]])) if more else b)
        out = {f"n_{k}": [sum(1 for s in b if s[2] == k) for b in bases] for k in KINDS}
        return out | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], "spans": [joined(s) for s in every]}

    return batch


def with_spans(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` and, last, a struct: counts of base spans by kind, their digest, and all spans.

    Null and empty texts have no spans; repeated rows have the same ones. Places are code points, ends are exclusive.
    The column is called ``out``; where ``df`` has that name, underscores come in front.
    """
    field = model()
    fields = "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return added(df, out, text_udf(df.sparkSession, lambda: _span_batch(field), fields)(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: counts and digest of the base spans and all spans of every document."""
    return with_spans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets.*")
