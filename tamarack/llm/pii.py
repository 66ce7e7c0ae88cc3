"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the base spans, which are observed, all other stretches that could be personal data by shape
(number groups, spelled-out addresses, words that repeat the local part of an address), and the words between these, a run of
which is one node that is observed to be outside. Neighbouring nodes share a chain edge. Distant nodes with the same or
a similar token (equal last digits, equal local part) share a skip edge with one occurrence of it, the hub, so the
edges grow with the text and never with its square, and no occurrence is far from the evidence of another.
Loopy message passing then makes the labels of one entity agree across the document.

The field is trained on texts made by rule (``planted``), once, on the driver; the workers get its weights.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, free_name, text_udf
from tamarack.llm.crf import PairwiseCRF

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: An added span needs at least this probability.
SURE = 0.8
NEAR = 24
ORDER = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match always starts with its digit run
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[^0-9]")
_GROUP = re.compile("[0-9]+")
_NUMBERS = re.compile(r"(?<![0-9A-Za-z+./])\(?[0-9][0-9 ()./-]{5,}[0-9](?![0-9A-Za-z])")
_DOT = r"(?:\.| ?[\[(](?:dot|\.)[\])] ?| dot )"
_AT = re.compile(r" ?[\[(](?:at|@)[\])] ?| at ", re.IGNORECASE)
_SPELLED = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", re.IGNORECASE)
_SPELLED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_DOTS = re.compile(_DOT, re.IGNORECASE)
_TOP = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z]{2,}$")
_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
_ANY_WORD = re.compile(r"\w")
#: Words that announce a kind of personal data.
CUES = {
    "email": re.compile(r"(?:e-?mail|mailto|contact|courriel|correo)\W*$", re.IGNORECASE),
    "ip": re.compile(r"(?:\bip|host|server|address)\W*$", re.IGNORECASE),
    "card": re.compile(r"(?:card|visa|mastercard|karte|carte|tarjeta)\W*$", re.IGNORECASE),
    "phone": re.compile(r"(?:phone|tel|telefon|mobile|cell|call|fax|téléphone|teléfono)\W*$", re.IGNORECASE),
}
#: The first five are the observed nodes, in the order of the labels.
FEATURES = [f"base_{k}" for k in KINDS] + ["plain"] + [f"cue_{k}" for k in KINDS]
FEATURES += ["at_bracket", "at_word", "spelled_dot", "many_dots", "local_name", "local_word", "ip_parts", "d7_9", "d10_13", "d14_19", "d20", "paren", "three_groups", "more_groups", "slash", "luhn", "bias"]
_F = {name: i for i, name in enumerate(FEATURES)}
_FIRST_CUE = _F[f"cue_{KINDS[0]}"]

Span = tuple[int, int, str]
Node = tuple[int, int, list[int], str | None]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, by start and kind.

    Written so that no text takes more than linear time.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m[0].split(".")) and all(int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
        out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


# ---------------------------------------------------------------- the field


def candidates(text: str, base: list[Span]) -> list[Node]:
    """(start, end, features, key) of stretches that may be personal data; they may overlap base spans and each other."""
    out: list[Node] = []
    if _DIGIT.search(text):
        if "dot" in text or "[.]" in text or "(.)" in text or "DOT" in text:
            for m in _SPELLED_IP.finditer(text):
                parts = _GROUP.findall(m[0])
                if all(int(p) <= 255 for p in parts):
                    out.append((m.start(), m.end(), [_F["ip_parts"], _F["spelled_dot"]], ".".join(parts)))
        for m in _NUMBERS.finditer(text):
            digits = _DIGITS.sub("", m[0])
            n = len(digits)
            if n < 7:
                continue
            f = [_F["d7_9" if n < 10 else "d10_13" if n < 14 else "d14_19" if n < 20 else "d20"]]
            groups = len(_GROUP.findall(m[0]))
            if groups >= 3:
                f.append(_F["three_groups" if groups == 3 else "more_groups"])
            f += [_F[name] for name, c in (("paren", "("), ("slash", "/")) if c in m[0]]
            if 14 <= n <= 19 and luhn(digits):
                f.append(_F["luhn"])
            out.append((m.start(), m.end(), f, _key(m[0], "")))
    done = 0
    for m in _AT.finditer(text):
        left = m.start()
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < m.start() and (domain := _SPELLED.match(text, m.end())) and _TOP.search(domain[0]):
            done = domain.end()
            f = [_F["at_word" if m[0] == " at " else "at_bracket"], _F["local_name" if _named(text[left : m.start()]) else "local_word"]]
            dots = _DOTS.findall(domain[0])
            f += [_F[name] for name, holds in (("spelled_dot", any(d != "." for d in dots)), ("many_dots", len(dots) > 1)) if holds]
            out.append((left, done, f, _key(text[left : m.start()], "email")))
    locals_ = {_key(text[s:e], k) for s, e, k in base if k == "email"} | {key for _, _, f, key in out if f[0] in (_F["at_word"], _F["at_bracket"])}
    if locals_:
        for m in _WORD.finditer(text):
            bare = m[0].rstrip(".")
            if text[m.end() : m.end() + 1] != "@" and (key := _key(bare, "email")) in locals_:
                out.append((m.start(), m.start() + len(bare), [_F["local_name" if _named(bare) else "local_word"]], key))
    return out


def _named(local: str) -> bool:
    """Whether a local part is more than a plain word."""
    return not local.isalpha()


def _key(token: str, kind: str) -> str:
    """What similar tokens share: the letters and digits of an address's local part, or the last ten digits of a number."""
    if kind == "email":
        return re.sub("[^a-z0-9]", "", token.partition("@")[0].lower()) or "@"
    digits = _DIGITS.sub("", token)
    return token if kind == "ip" else "#" + (digits[-10:] if len(digits) <= 13 else digits)


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """The nodes of a text by place: base spans, candidates that overlap none of them, and the runs of words between; none without candidates."""
    extra = candidates(text, base)
    found: list[Node] = [(s, e, [_F[f"base_{k}"]], _key(text[s:e], k)) for s, e, k in base]
    extra.sort(key=lambda x: (x[0], -x[1]))
    i, last, free = 0, -1, 0
    for s, e, f, key in extra:
        while i < len(base) and base[i][1] <= s:
            i += 1
        j = i
        while j < len(base) and base[j][0] < e and base[j][1] <= s:
            j += 1
        if s < last or (j < len(base) and base[j][0] < e):
            continue
        last = e
        free += 1
        found.append((s, e, f, key))
    if not free:
        return []
    found.sort(key=lambda x: (x[0], x[1]))
    out: list[Node] = []
    at = 0
    for s, e, f, key in found:
        if s > at and _ANY_WORD.search(text, at, s):
            out.append((at, s, [_F["plain"]], None))
        before = text[max(0, s - NEAR) : s]
        out.append((s, e, [*f, *(_F[f"cue_{k}"] for k, cue in CUES.items() if cue.search(before)), _F["bias"]], key))
        at = max(at, e)
    if _ANY_WORD.search(text, at):
        out.append((at, len(text), [_F["plain"]], None))
    return out


def graph(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(earlier, later, type) edges: 0 between neighbours, 1 between the hub of a token and its other occurrences.

    The hub is the first base span of the token, else the first occurrence with a cue, else the first.
    """
    edges, hubs = [(i - 1, i, 0) for i in range(1, len(nodes))], {}
    for i, (_, _, f, key) in enumerate(nodes):
        if key is not None:
            rank = 0 if f[0] < OUTSIDE else 1 if any(_FIRST_CUE <= x < _FIRST_CUE + len(KINDS) for x in f) else 2
            if key not in hubs or rank < hubs[key][0]:
                hubs[key] = rank, i
    for i, (_, _, _, key) in enumerate(nodes):
        if key is not None and (hub := hubs[key][1]) != i:
            edges.append((min(hub, i), max(hub, i), 1))
    return edges


def _stacked(parts: list[list[Node]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, edges, edge types and observed labels (-1: none) of several texts side by side."""
    x = np.zeros((sum(map(len, parts)), len(FEATURES)))
    fixed = np.full(len(x), -1)
    edges, types, at = [], [], 0
    for nodes in parts:
        for i, (_, _, f, _) in enumerate(nodes):
            x[at + i, f] = 1
            if f[0] <= OUTSIDE:
                fixed[at + i] = f[0]
        for a, b, kind in graph(nodes):
            edges.append((at + a, at + b))
            types.append(kind)
        at += len(nodes)
    return x, np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(types, dtype=np.int64), fixed


# ---------------------------------------------------------------- training texts

#: Words, names and domains of the training texts; tests score the field on other ones.
TRAINING = {
    "words": ("the order", "was sent", "to them", "on that day", "and then", "with it", "look at", "we stayed at", "page"),
    "users": ("jo", "kim", "lee", "anna", "max"),
    "roles": ("info", "sales", "office", "contact"),
    "domains": ("mail.example.com", "example.org", "post.example.net"),
}


def planted(rng: random.Random, names: dict[str, tuple[str, ...]] = TRAINING) -> tuple[str, list[Span]]:
    """A text made by rule, and its personal data: what the base patterns find, and forms that they miss.

    Missed forms: numbers without a plus sign that repeat one or follow a cue, spelled-out addresses, repeated local parts,
    spelled-out IP addresses and cards with other separators. Between them stand numbers and words that are nobody's data.
    """
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    fill = lambda: " ".join(rng.choice(names["words"]) for _ in range(rng.randint(1, 9)))
    pieces: list[tuple[str, str, str | None]] = []  # what goes before, the piece, its kind
    for _ in range(rng.randint(1, 5)):
        kind, area, middle, end = rng.random(), rng.choice("23456789") + digits(2), digits(3), digits(4)
        user = rng.choice(names["users"]) + rng.choice(("", ".", "_")) + digits(rng.randint(1, 4))
        domain = rng.choice(names["domains"])
        at, dot = rng.choice(((" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" [AT] ", ".")))
        number = rng.choice((f"1-{area}-{middle}-{end}", f"({area}) {middle}-{end}", f"{area} {middle} {end}", f"{area}.{middle}.{end}"))
        if kind < 0.2:
            pieces += [("", f"+1 ({area}) {middle}-{end}", "phone")] + [("", number, "phone")] * rng.randint(0, 2)
        elif kind < 0.27:
            pieces += [(rng.choice(("call ", "Tel: ", "phone ", "fax ")), number, "phone")] + [("", number, "phone")] * rng.randint(0, 2)
        elif kind < 0.4:
            pieces += [("", f"{user}@{domain}", "email")] + [("", rng.choice((user, user + at + domain.replace(".", dot))), "email")] * rng.randint(0, 2)
        elif kind < 0.48:
            pieces += [("", user + at + domain.replace(".", dot), "email")] + [("", user, "email")] * rng.randint(0, 1)
        elif kind < 0.53:
            role = rng.choice(names["roles"])
            pieces += [("", f"{role}@{domain}", "email")] + [("", role, None)] * rng.randint(1, 2)
        elif kind < 0.6:
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            pieces += [("", rng.choice((".", "[.]", " dot ", "(.)")).join(parts), "ip")]
        elif kind < 0.68:
            raw = digits(15)
            card = raw + next(c for c in "0123456789" if luhn(raw + c))
            pieces += [("", rng.choice(("", " ", ".", "/")).join(card[i : i + 4] for i in (0, 4, 8, 12)), "card")]
        else:
            wrong = digits(15)
            wrong += next(c for c in "0123456789" if not luhn(wrong + c))
            n = rng.choice((digits(8), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", digits(12), f"{digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(4)}", digits(17), digits(24), wrong, f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}"))
            n = rng.choice((n, n, f"at {domain}"))
            pieces += [("", n, None)] * rng.choice((1, 1, 2))
    rng.shuffle(pieces)
    text, marks = "", []
    for before, piece, kind in pieces:
        text += fill() + " " + before
        if kind is not None:
            marks.append((len(text), len(text) + len(piece), kind))
        text += piece + rng.choice((" ", ", ", ". "))
    return text, marks


def trained(seed: int = 11, texts: int = 300) -> PairwiseCRF:
    """The field, trained on ``planted`` texts; the same every time."""
    rng = random.Random(seed)
    parts, gold = [], []
    for _ in range(texts):
        text, marks = planted(rng)
        nodes = nodes_of(text, base_spans(text))
        parts.append(nodes)
        gold += [f[0] if f[0] <= OUTSIDE else next((ORDER[k] for a, b, k in marks if s < b and a < e), OUTSIDE) for s, e, f, _ in nodes]
    model = PairwiseCRF(len(FEATURES), len(KINDS) + 1, 2)
    x, edges, types, fixed = _stacked(parts)
    model.fit(x, np.array(gold), edges, types, fixed)
    return model


_MODEL: list[PairwiseCRF] = []


def model() -> PairwiseCRF:
    """The trained field; once per process."""
    if not _MODEL:
        _MODEL.append(trained())
    return _MODEL[0]


def added_spans(texts: list[str], bases: list[list[Span]], field: PairwiseCRF) -> list[list[Span]]:
    """Spans that the field adds to the base spans of each text."""
    parts = [nodes_of(t, b) for t, b in zip(texts, bases, strict=True)]
    out: list[list] = [[] for _ in texts]
    busy = [i for i, nodes in enumerate(parts) if nodes]
    if not busy:
        return out
    x, edges, types, fixed = _stacked([parts[i] for i in busy])
    node, _ = field.marginals(field.node_scores(x, fixed), edges, types)
    label, sure = node.argmax(axis=1), node.max(axis=1)
    at = 0
    for i in busy:
        for j, (s, e, f, _) in enumerate(parts[i]):
            if f[0] > OUTSIDE and label[at + j] != OUTSIDE and sure[at + j] >= SURE:
                out[i].append((s, e, KINDS[label[at + j]]))
        at += len(parts[i])
    return out


def all_spans(texts: list[str], field: PairwiseCRF) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, base and added spans) of each text, by start, kind and end."""
    bases = [base_spans(t) for t in texts]
    more = added_spans(texts, bases, field)
    return bases, [sorted(b + m, key=lambda s: (s[0], ORDER[s[2]], s[1])) if m else b for b, m in zip(bases, more, strict=True)]


# ---------------------------------------------------------------- operator


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, e, k in spans])


def _span_batch(field: PairwiseCRF):
    def batch(texts: list) -> dict:
        bases, every = all_spans([t or "" for t in texts], field)
        counts = {f"n_{k}": [sum(1 for s in b if s[2] == k) for b in bases] for k in KINDS}
        return counts | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], "spans": [joined(s) for s in every]}

    return batch


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def _mask_batch(field: PairwiseCRF):
    def batch(texts: list) -> dict:
        _, spans = all_spans([t or "" for t in texts], field)
        return {"masked": [None if t is None else masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]}

    return batch


def with_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` and, last, a struct: counts of base spans by kind, their digest, and all spans.

    Null and empty texts have no spans; repeated rows have the same ones. Places are code points, ends are exclusive.
    The column is called ``out``; where ``df`` has that name, underscores come in front.
    """
    field = model()
    fields = "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return added(df, out, text_udf(df.sparkSession, lambda: _span_batch(field), fields)(F.col(text)))


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced by its kind; null stays null, clean texts and all other columns stay as they are."""
    field, name = model(), free_name(df, "masked")
    done = df.withColumn(name, text_udf(df.sparkSession, lambda: _mask_batch(field), "masked string")(F.col(text))["masked"])
    return done.select(*(F.col(name).alias(c) if c == text else F.col(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts and digest of the base spans and all spans of every document."""
    return with_spans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii.*")
