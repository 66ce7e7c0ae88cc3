"""Audits: claims of an answer against its evidence, risks and scenario checks of a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import once

#: Forms of claims that need evidence, units that mean the same, words of policies and of deferrals.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
UNIT = "L/100km|l/100km|升/百公里|kWh|KWh|度|万元|万|公里|km|毫米|mm|分钟|min|座|升|L|%|分"
HARD_CLAIM = rf"({NUMBER}\s*(?:[-~—–至到]\s*{NUMBER})?)\s*({UNIT})"
UNITS = {"万元": "万", "公里": "km", "毫米": "mm", "kwh": "kWh", "度": "kWh", "min": "分钟", "升": "L", "l": "L", "l/100km": "L/100km", "升/百公里": "L/100km"}
SOURCE = "《([^》]+)》"
CITATION = r"\[([0-9]+)\]"
SOURCE_LINE = r"(?m)^\s*\[([0-9]+)\]\s*([^\n]+)"
IGNORED = r"[\s\p{Zs},，。；;：:\[\]（）()、+]+"
SENTENCE_END = "[。；;\\n]"
POLICY = "保修|质保|权益|政策"
PROMISE = r"终身|免费|赠送|承诺|包含|提供|可获得|可享|首任|三电|不限|[0-9]+\s*(?:年|万公里|公里)"
AUTHORITY, DEFERRAL = "官方|品牌", "为准|核验|确认|咨询|公布"
LOW_QUALITY = 85
PASS, WARN = 85, 70


def compact(c):
    return F.regexp_replace(F.lower(c), IGNORED, "")


def _plain_number(x):
    x = F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)


def _claims(c):
    """Array of (claim, key): the key is its sorted numbers and its unit, written one way."""
    found = lambda g: F.regexp_extract_all(c, F.lit(HARD_CLAIM), F.lit(g))
    units = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    unit = lambda u: F.coalesce(F.element_at(units, F.lower(u)), u)
    numbers = lambda n: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(n, F.lit(f"({NUMBER})"), F.lit(1)), _plain_number)))
    parts = F.arrays_zip(found(0).alias("claim"), found(1).alias("numbers"), found(2).alias("unit"))
    return F.transform(parts, lambda p: F.struct(p["claim"].alias("claim"), F.concat(F.array_join(numbers(p["numbers"]), "|"), F.lit(" "), unit(p["unit"])).alias("key")))


def _first_of_equal(texts):
    """Trimmed texts without those whose compact form came before."""
    return once(F.transform(texts, lambda x: F.trim(x)), lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, compact), compact(x)) == i + 1))


def grounding_errors(answer, evidence):
    """Array of errors of an answer: numbers with a unit, sources, citations and policies that its evidence lacks.

    Null answers have one error, null evidence supports nothing. Policies that point to the maker are no claims.
    """
    text, known = F.coalesce(answer, F.lit("")), compact(F.coalesce(evidence, F.lit("")))
    keys = F.transform(_claims(F.coalesce(evidence, F.lit(""))), lambda x: x["key"])
    missing = lambda x: ~F.contains(known, compact(x))
    tag = lambda label, xs: F.transform(xs, lambda x: F.concat(F.lit(f"unsupported {label}: "), x))
    hard = F.transform(F.filter(_claims(text), lambda x: missing(x["claim"]) & ~F.array_contains(keys, x["key"])), lambda x: x["claim"])
    sources = F.filter(F.regexp_extract_all(text, F.lit(SOURCE), F.lit(1)), missing)
    line = lambda g: F.regexp_extract_all(text, F.lit(SOURCE_LINE), F.lit(g))
    lines = F.filter(F.arrays_zip(line(1).alias("n"), line(2).alias("line")), lambda x: (compact(x["line"]) != "") & missing(x["line"]))
    cited = F.array_sort(F.array_except(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), line(1)))
    deferred = lambda x: F.regexp_like(compact(x), F.lit(AUTHORITY)) & F.regexp_like(compact(x), F.lit(DEFERRAL))
    policies = F.filter(F.split(text, SENTENCE_END), lambda x: F.regexp_like(x, F.lit(POLICY)) & F.regexp_like(x, F.lit(PROMISE)) & missing(x) & ~deferred(x))
    errors = F.concat(
        tag("hard claim", _first_of_equal(hard)),
        tag("quoted source", _first_of_equal(sources)),
        F.transform(lines, lambda x: F.concat(F.lit("unsupported bracket source: ["), x["n"], F.lit("] "), F.trim(x["line"]))),
        F.transform(cited, lambda n: F.concat(F.lit("unsupported bracket citation: ["), n, F.lit("]"))),
        tag("policy claim", _first_of_equal(policies)),
    )
    return F.when(answer.isNull(), F.array(F.lit("answer is missing"))).otherwise(errors)


def confusion(audited: DataFrame, good, errors: str = "errors") -> DataFrame:
    """(cases, false_positives, false_negatives, passed): good answers with errors and bad ones without."""
    clean = F.size(errors) == 0
    counts = audited.agg(F.count("*").alias("cases"), F.count_if(good & ~clean).alias("false_positives"), F.count_if(~good & clean).alias("false_negatives"))
    return counts.withColumn("passed", (F.col("false_positives") == 0) & (F.col("false_negatives") == 0))


def risk_checks(cases: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """(key, risks) of every case. ``cases``: key, budget, home_charger; ``ranked``: key, rank, price, energy, quality, cautions.

    Null budgets and unknown chargers raise no risk; null qualities count as good; a case without rows has the risk
    ``no candidates``, one without any risk ``none``.
    """
    j = cases.select(key, "budget", "home_charger").join(ranked, key, "left")
    top = F.col("rank") <= 3
    g = j.groupBy(key).agg(
        F.count("rank").alias("rows"),
        F.coalesce(F.every(F.when(top, F.coalesce(F.col("price"), F.lit(0.0)) > F.col("budget"))) & (F.max("budget") > 0), F.lit(False)).alias("over"),
        (F.count_if(top & (F.col("energy") == "electric") & ~F.col("home_charger")) >= 2).alias("electric"),
        (F.count_if(F.col("quality") < LOW_QUALITY) > 0).alias("low"),
        (F.coalesce(F.sum(F.when(F.col("rank") <= 5, F.col("cautions"))), F.lit(0)) > 0).alias("cautions"),
    )
    risks = F.array_compact(F.array(F.when(F.col("over"), "over budget"), F.when(F.col("electric"), "electric without charger"), F.when(F.col("low"), "low data quality"), F.when(F.col("cautions"), "cautions")))
    return g.select(key, F.when(F.col("rows") == 0, F.array(F.lit("no candidates"))).when(F.size(risks) == 0, F.array(F.lit("none"))).otherwise(risks).alias("risks"))


def scenario_checks(cases: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """(key, passed, checks, score, status) of every case against its five best rows.

    ``cases``: key and the arrays model_any (in the first five), top_all (all in the first two), energy_any and type_any
    (in the first three); null or empty arrays ask nothing. ``ranked``: key, rank, name, energy, type.
    """
    best = ranked.where("rank <= 5").groupBy(key).agg(*(F.collect_set(F.when(F.col("rank") <= n, F.col(c))).alias(a) for a, c, n in (("top5", "name", 5), ("top2", "name", 2), ("energies", "energy", 3), ("types", "type", 3))))
    j = cases.join(best, key, "left")
    none = lambda c: F.coalesce(F.col(c), F.array())
    rules = [("model_any", F.arrays_overlap("model_any", "top5")), ("top_all", F.size(F.array_except("top_all", "top2")) == 0), ("energy_any", F.arrays_overlap("energy_any", "energies")), ("type_any", F.arrays_overlap("type_any", "types"))]
    asked = sum(F.when(F.size(none(c)) > 0, 1).otherwise(0) for c, _ in rules)
    passed = sum(F.when((F.size(none(c)) > 0) & F.coalesce(ok, F.lit(False)), 1).otherwise(0) for c, ok in rules)
    s = j.select(key, passed.alias("passed"), asked.alias("checks")).withColumn("score", F.round(F.col("passed") / F.greatest(F.col("checks"), F.lit(1)) * 100, 1))
    return s.withColumn("status", F.when(F.col("score") >= PASS, "pass").when(F.col("score") >= WARN, "warn").otherwise("fail"))


def explain_top(ranked: DataFrame, key: str, roomy: tuple[str, ...] = ("SUV", "MPV")) -> DataFrame:
    """(key, rank, best_for, stronger) of the three best rows of every case.

    ``ranked``: key, rank, type, home_charger, concerns and the scores ``budget``, ``space`` and ``charging`` (null: 0).
    ``stronger`` names the scores that no other of the three exceeds; a row without others has ``too few``.
    """
    all_of = W.partitionBy(key)
    worried = lambda word: F.coalesce(F.array_contains("concerns", word), F.lit(False))
    best_for = F.when(worried("空间") & F.col("type").isin(*roomy), "space").when(worried("补能") | F.coalesce(~F.col("home_charger"), F.lit(False)), "charging").when(worried("智驾"), "assistance").otherwise("balance")
    score = lambda c: F.coalesce(F.col(c), F.lit(0))
    stronger = F.array_compact(F.array(*(F.when(score(c) >= F.max(score(c)).over(all_of), c) for c in ("budget", "space", "charging"))))
    top = ranked.where("rank <= 3")
    return top.select(key, "rank", best_for.alias("best_for"), F.when(F.count("*").over(all_of) == 1, F.array(F.lit("too few"))).otherwise(stronger).alias("stronger"))
