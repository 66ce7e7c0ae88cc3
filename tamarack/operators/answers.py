"""Checks of model answers: tool calls, names, claims, copies, divergence and run metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tamarack.functions import text as X

#: Form of a tool call, token budget of an answer, shares of the answer's score.
TOOL_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
BUDGET, SLACK = 384, 128
PRECISION, COVERAGE, INTEGRITY, CONCISION = 0.45, 0.30, 0.15, 0.10
LONGEST = 800
SEGMENT = r"[;!?\n。；！？]|\.(?:\s|$)"


def pairing_errors(messages: DataFrame, key: str = "key") -> DataFrame:
    """(key, error) of each trajectory: its first error, or null.

    ``messages`` has key, idx (from 0), role and call_id: the call of an assistant (null: final answer) or the
    result of a tool. Rows of one trajectory only meet in its own window; equal keys and idx are an error of the input.
    """
    line = W.partitionBy(key).orderBy("idx")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy(key, "role", "call_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    by_id = W.partitionBy(key, "call_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    late = F.col("idx") >= 2
    call = late & (F.col("role") == "assistant") & F.col("call_id").isNotNull()
    result = late & (F.col("role") == "tool")
    count = lambda c, w: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    m = messages.withColumns(
        {
            "open": count(call, before) - count(result, before),
            "ended": count(late & (F.col("role") == "assistant") & F.col("call_id").isNull(), before) > 0,
            "again": count(call | result, same) > 0,
            "called": count(call, by_id) > 0,
            "last": F.lead("idx").over(line).isNull(),
        }
    )
    error = (
        F.when((F.col("idx") == 0) & (F.col("role") != "system") | (F.col("idx") == 1) & (F.col("role") != "user"), "bad start")
        .when(late & F.col("role").isin("system", "user"), "late role")
        .when(late & F.col("ended"), "after the end")
        .when(late & (F.col("role") == "assistant") & (F.col("open") > 0), "missing result")
        .when(call & F.col("again"), "duplicate call")
        .when(result & (~F.col("called") | F.col("again")), "unknown call")
        .when(F.col("last") & (F.col("open") + call.cast("int") - result.cast("int") > 0), "pending at the end")
    )
    return m.withColumn("e", error).groupBy(key).agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("idx"))).alias("error"))


def tool_calls(c):
    """Struct of residual text and called names. One bad call makes the whole text plain: no names, text as it is."""
    payloads = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(1))

    def good(p):
        name = F.try_variant_get(F.try_parse_json(p), "$.name", "variant")
        arguments = F.try_variant_get(F.try_parse_json(p), "$.arguments", "variant")
        decoded = F.when(F.schema_of_variant(arguments) == "STRING", F.try_parse_json(F.get_json_object(p, "$.arguments"))).otherwise(arguments)
        exact = F.array_sort(F.json_object_keys(p)) == F.array(F.lit("arguments"), F.lit("name"))
        return F.coalesce(exact & (F.schema_of_variant(name) == "STRING") & (F.trim(F.get_json_object(p, "$.name")) != "") & F.schema_of_variant(decoded).startswith("OBJECT"), F.lit(False))

    ok = F.forall(payloads, good) & (F.size(payloads) > 0)
    return F.struct(
        F.when(ok | ~F.contains(c, F.lit("<tool_call>")), F.trim(F.regexp_replace(c, TOOL_CALL, ""))).otherwise(c).alias("residual"),
        F.when(ok, F.transform(payloads, lambda p: F.get_json_object(p, "$.name"))).otherwise(F.array().cast("array<string>")).alias("names"),
    )


def greedy_names(aliases: list[tuple[int, str, str]]):
    """Arrow UDF: names in a text in order of place, from (priority, alias, name) that is a small fixed list.

    Matches may not overlap; lower priority, then longer alias, earlier place and smaller name go first. Null texts have none.
    """

    def names(text: str | None) -> list[str]:
        found = []
        for priority, alias, name in aliases:
            at = text.find(alias) if text and alias else -1
            while at >= 0:
                found.append((priority, -len(alias), at, name))
                at = text.find(alias, at + 1)
        taken, kept = bytearray(len(text or "")), []
        for _, size, at, name in sorted(found):
            if not any(taken[at : at - size]):
                taken[at : at - size] = b"\x01" * -size
                kept.append((at, at - size, name))
        return [name for _, _, name in sorted(kept)]

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(names)

    return run


def occurrences(c, value):
    """Occurrences of a value that do not overlap; none of an empty one."""
    return F.when(F.length(value) > 0, (F.length(c) - F.length(F.replace(c, value, F.lit("")))) / F.length(value)).otherwise(0.0).cast("long")


def copy_ratio(c, evidence, n: int = 5):
    """Share of a text's character n-grams that occur in the evidence; 0 for shorter texts."""
    grams = X.char_ngrams(c, n)
    return F.coalesce(F.try_divide(F.size(F.filter(grams, lambda g: F.contains(evidence, g))), F.size(grams)), F.lit(0.0))


def duplicate_ratio(c, values):
    """Repeated mentions of the values over all mentions; 0 without mentions."""
    counts = F.transform(values, lambda v: occurrences(c, v))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    again = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0).cast("long"), x - 1))
    return F.coalesce(F.try_divide(again, total), F.lit(0.0))


def verbosity(tokens):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (tokens - BUDGET) / SLACK))


def token_kl(policy, reference, tokens, end: int):
    """exp(r - p) - (r - p) - 1 of every token up to the first ``end``, that token included."""
    kl = F.zip_with(policy, reference, lambda p, r: F.exp(r - p) - (r - p) - 1)
    at = F.array_position(tokens, F.lit(end))
    return F.slice(kl, F.lit(1), F.when(at > 0, at).otherwise(F.size(kl)).cast("int"))


def run_metrics(cases: DataFrame) -> DataFrame:
    """(metric, num, den, ratio) of a model run in one pass; nothing over nothing is 0.

    ``cases``: success, schema_valid, disallowed, calls_valid, has_allowed and hit (boolean); mandatory, matched,
    declared, unresolved, known and undeclared (numbers of tools and names).
    """
    c = F.col
    complete = c("matched") == c("mandatory")
    consistent = c("schema_valid") & (c("undeclared") == 0)
    one, every = lambda b: F.when(b, 1).otherwise(0), F.lit(1)
    parts = {
        "tool_selection_accuracy": (one(c("success") & ~c("disallowed") & complete), every),
        "argument_validity": (one(c("success") & complete & c("calls_valid")), every),
        "recommendation_hit_rate": (one(c("success") & c("has_allowed") & c("hit")), one(c("has_allowed"))),
        "hallucination_rate": (c("unresolved"), c("declared")),
        "response_schema_validity": (one(consistent), every),
        "declared_model_coverage": (c("known") - c("undeclared"), c("known")),
        "response_contract_consistency": (one(consistent), every),
        "mandatory_tool_coverage": (F.when(c("success"), c("matched")).otherwise(0), c("mandatory")),
    }
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    sums = cases.agg(*(F.struct(F.lit(m).alias("metric"), total(a, "num"), total(b, "den")).alias(m) for m, (a, b) in parts.items()))
    rows = sums.select(F.explode(F.array(*parts)).alias("m")).select("m.*")
    return rows.withColumn("ratio", F.coalesce(F.round(F.try_divide("num", "den"), 6), F.lit(0.0)))


def grounded_score(answers: DataFrame, claims: DataFrame, key: str = "key") -> DataFrame:
    """(key, matched, unsupported, precision, coverage, integrity, concision, total) of every answer.

    ``answers`` has key, answer and minimum (claims asked for); ``claims`` has key, entity, attribute, value, tool
    and locator. Claims meet the segments of their own answer only. A claim matches if one segment has entity,
    attribute and value; equal claims count once. A segment with entity, attribute and a further number but none
    of their values is unsupported, once for each entity and attribute. Null answers count as empty; the total is 0
    below the minimum.
    """
    text = F.lower(F.coalesce("answer", F.lit("")))
    segments = answers.select(key, F.posexplode(F.split(text, SEGMENT)).alias("at", "segment")).where(F.trim("segment") != "")
    pairs = segments.join(claims, key).where(F.contains("segment", F.lower("entity")) & F.contains("segment", F.lower("attribute")))
    rest = F.replace(F.replace(F.col("segment"), F.lower("entity"), F.lit(" ")), F.lower("attribute"), F.lit(" "))
    number = F.concat(F.lit(r"(?<![0-9])"), F.regexp_replace(F.lower("value"), r"([^\p{L}\p{N}])", r"\\$1"), F.lit(r"(?![0-9])"))
    hit = F.regexp_like(rest, number)
    groups = pairs.groupBy(key, "at", "entity", "attribute").agg(F.collect_set(F.when(hit, F.struct("tool", "locator", "value"))).alias("found"), F.max(F.regexp_like(rest, F.lit("[0-9]"))).alias("numeric"))
    bad = groups.groupBy(key).agg(F.count_if((F.size("found") == 0) & F.col("numeric")).alias("unsupported"))
    good = groups.select(key, "entity", "attribute", F.explode("found").alias("f")).distinct()
    sourced = (F.coalesce("f.tool", F.lit("")) != "") & (F.coalesce("f.locator", F.lit("")) != "")
    met = good.groupBy(key).agg(F.count("*").alias("matched"), F.count_if(sourced).alias("sourced"))
    s = answers.select(key, "minimum", F.length(F.regexp_replace(text, r"[^\p{L}\p{N}+.-]", "")).alias("size")).join(met, key, "left").join(bad, key, "left").na.fill(0, ["matched", "sourced", "unsupported"])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns(
        {
            "precision": share(F.col("matched"), F.col("matched") + F.col("unsupported")),
            "coverage": F.least(share(F.col("matched"), F.col("minimum")), F.lit(1.0)),
            "integrity": share(F.col("sourced"), F.col("matched")),
            "concision": F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.col("size") - LONGEST) / LONGEST),
        }
    )
    total = PRECISION * F.col("precision") + COVERAGE * F.col("coverage") + INTEGRITY * F.col("integrity") + CONCISION * F.col("concision")
    return s.select(key, "matched", "unsupported", "precision", "coverage", "integrity", "concision", F.when(F.col("matched") >= F.col("minimum"), total).otherwise(0.0).alias("total"))
