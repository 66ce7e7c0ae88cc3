"""Text functions as column expressions; the Unicode ones that have no built-in are Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of the identity key.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def ascii_key(c):
    """Trimmed, collapsed, lower-cased text: the identity key of ASCII texts."""
    return F.lower(F.trim(F.regexp_replace(c, SPACES, " ")))


@F.pandas_udf(StringType())
def nfkc_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Identity key of any text: NFKC, collapsed white space, case folded. Null stays null."""
    for s in batches:
        yield s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


@F.pandas_udf(StringType())
def match_token(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, case folded, letters, digits and ``+ - .`` only."""
    for s in batches:
        yield s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum() or c in "+-."))


def compact(c):
    """Name without spaces and joining marks, lower case."""
    return F.lower(F.regexp_replace(c, "[ \\-_.]+", ""))


def compact_text(c):
    """Lower-cased text without white space and listing marks."""
    return F.lower(F.regexp_replace(c, r"[\s,，。；;：:\[\]（）()、+]+", ""))


def slug(c):
    """File-name form: path-illegal characters and spaces become one dash; ``untitled`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|\s]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def once(c, use):
    """``use(value)`` with ``c`` evaluated once for a row, not once for each element inside ``use``."""
    return F.element_at(F.transform(F.array(c), use), 1)


def chunks(c, size: int, stride: int):
    """Fixed-size pieces of a text; the last one may be a suffix of the one before. Empty and null texts have none.

    The text is cut into strides in one pass; a piece is its stride and the start of the next one, so the work is linear
    in the length. The overlap must not be longer than the stride.
    """
    if not stride <= size <= 2 * stride:
        raise ValueError("size must be between one stride and two")
    blocks = F.coalesce(F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{stride}}})"), F.lit(1)), F.array().cast("array<string>"))
    return once(blocks, lambda b: F.transform(b, lambda x, i: F.concat(x, F.left(F.coalesce(F.get(b, i + 1), F.lit("")), F.lit(size - stride)))))


def char_ngrams(c, n: int):
    """All character n-grams in order; none if the text is shorter. Linear in the length of the text."""
    none = F.array().cast("array<string>")
    gram = lambda cs, i: F.concat(*(F.element_at(cs, i + j) for j in range(n)))
    return once(F.split(c, ""), lambda cs: F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: gram(cs, i))).otherwise(none))


def masked_secret(c):
    """Empty stays empty, short values become stars, longer ones keep their last four characters."""
    return F.when(c == "", c).when(F.length(c) <= 4, "***").otherwise(F.concat(F.lit("***"), F.right(c, F.lit(4))))


def excerpt(c, limit: int = 160):
    """Lines joined by spaces, leading marks stripped, cut with three dots."""
    line = F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "^[#* -]+", ""))), lambda x: x != ""), " ")
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("..."))).otherwise(line)
