"""Checks of model answers: call pairing, call parsing, names, copies, divergence, run metrics, grounding."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators import answers as A
from tamarack.plans.registry import query
from tamarack.session import table as t


@query("tool_call_pairing", """WITH e AS (SELECT event_id // 6 AS traj, event_id % 6 AS idx, event_type AS et, CAST(props ->> 'k' AS INT) AS k FROM events),
m AS (SELECT traj, idx, CASE WHEN idx = 0 THEN 'system' WHEN idx = 1 OR k % 11 = 0 THEN 'user' WHEN idx IN (2, 4) THEN 'assistant' WHEN idx = 3 OR et IN ('view', 'click') THEN 'tool' ELSE 'assistant' END AS role,
CASE WHEN idx = 2 THEN traj % 3 WHEN idx = 3 THEN CASE WHEN et = 'error' THEN k % 3 ELSE traj % 3 END WHEN idx = 4 AND k % 2 = 0 OR idx = 5 AND et NOT IN ('view', 'click') THEN NULL ELSE k % 3 END AS id FROM e),
f AS (SELECT *, idx >= 2 AND role = 'assistant' AND id IS NOT NULL AS c, idx >= 2 AND role = 'tool' AS r FROM m),
b AS (SELECT f.traj, f.idx, any_value(f.role) AS role, bool_or(f.c) AS c, bool_or(f.r) AS r, count(*) FILTER (g.c) - count(*) FILTER (g.r) AS pend, count(*) FILTER (g.idx >= 2 AND g.role = 'assistant' AND g.id IS NULL) AS ended, count(*) FILTER (g.c AND g.id = f.id) AS called, count(*) FILTER (g.r AND g.id = f.id) AS used, max(n.mx) AS mx
FROM f JOIN (SELECT traj, max(idx) AS mx FROM f GROUP BY traj) n USING (traj) LEFT JOIN f g ON g.traj = f.traj AND g.idx < f.idx GROUP BY f.traj, f.idx),
x AS (SELECT traj, idx, CASE WHEN idx = 0 AND role <> 'system' OR idx = 1 AND role <> 'user' THEN 'bad start' WHEN idx >= 2 AND role IN ('system', 'user') THEN 'late role' WHEN idx >= 2 AND ended > 0 THEN 'after the end'
WHEN idx >= 2 AND role = 'assistant' AND pend > 0 THEN 'missing result' WHEN c AND called > 0 THEN 'duplicate call' WHEN r AND (called = 0 OR used > 0) THEN 'unknown call' WHEN idx = mx AND pend + CAST(c AS INT) - CAST(r AS INT) > 0 THEN 'pending at the end' END AS error FROM b)
SELECT CAST(traj AS BIGINT) AS traj, arg_min(error, idx) FILTER (error IS NOT NULL) AS error FROM x GROUP BY traj""")
def tool_call_pairing(spark, d):
    """First error of each trajectory of six messages."""
    k, et, i = F.get_json_object("props", "$.k").cast("int"), F.col("event_type"), F.col("idx")
    e = t(spark, d, "events").withColumn("traj", F.floor(F.col("event_id") / 6)).withColumn("idx", F.col("event_id") % 6)
    seen = et.isin("view", "click")
    role = F.when(i == 0, "system").when((i == 1) | (k % 11 == 0), "user").when(i.isin(2, 4), "assistant").when((i == 3) | seen, "tool").otherwise("assistant")
    own = F.col("traj") % 3
    call = F.when(i == 2, own).when(i == 3, F.when(et == "error", k % 3).otherwise(own)).when(((i == 4) & (k % 2 == 0)) | ((i == 5) & ~seen), None).otherwise(k % 3)
    return A.pairing_errors(e.select("traj", "idx", role.alias("role"), call.alias("call_id")), "traj")


#: Texts of model output; text i goes to events whose id has the remainder i.
OUTPUTS = [
    'Hi <tool_call>{"name": "find", "arguments": {"q": 1}}</tool_call>',
    '<tool_call> {"name": "find", "arguments": "{}"} </tool_call> and <tool_call>{"arguments": {}, "name": "rank"}</tool_call>',
    '<tool_call>{"name": "find"}</tool_call>',
    '<tool_call>{"name": " ", "arguments": {}}</tool_call>',
    '<tool_call>{"name": "find", "arguments": {}}</tool_call><tool_call>{"name": "find", "arguments": [1]}</tool_call>',
    "no call",
    "<tool_call>cut",
    '<tool_call>{"name": 3, "arguments": {}}</tool_call>',
]
_XML = A.TOOL_CALL
_OUT_SQL = "[" + ", ".join(f"'{x}'" for x in OUTPUTS) + "]"


@query("tool_call_xml", f"""WITH o AS (SELECT event_id, {_OUT_SQL}[1 + event_id % {len(OUTPUTS)}] AS c FROM events), p AS (SELECT *, regexp_extract_all(c, '{_XML}', 1) AS ps FROM o),
g AS (SELECT *, len(list_filter(ps, lambda x: list_sort(json_keys(x)) = ['arguments', 'name'] AND json_type(x, '$.name') = 'VARCHAR' AND trim(json_extract_string(x, '$.name')) <> '' AND (json_type(x, '$.arguments') = 'OBJECT' OR json_type(x, '$.arguments') = 'VARCHAR' AND starts_with(json_extract_string(x, '$.arguments'), '{{')))) AS good FROM p)
SELECT event_id, CASE WHEN len(ps) > 0 AND good = len(ps) OR NOT contains(c, '<tool_call>') THEN trim(regexp_replace(c, '{_XML}', '', 'g')) ELSE c END AS residual, CASE WHEN len(ps) > 0 AND good = len(ps) THEN array_to_string(list_transform(ps, lambda x: json_extract_string(x, '$.name')), '|') ELSE '' END AS names FROM g""")
def tool_call_xml(spark, d):
    """Calls written into a text: all of them, or none if one is malformed."""
    c = F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.col("event_id") % len(OUTPUTS) + 1).cast("int"))
    o = t(spark, d, "events").select("event_id", c.alias("c")).select("event_id", A.tool_calls(F.col("c")).alias("r"))
    return o.select("event_id", "r.residual", F.array_join("r.names", "|").alias("names"))


#: (priority, alias, name): whole names first.
ALIASES = [(0, "large brass", "large brass"), (0, "small tin", "small tin"), (1, "brass", "brass"), (1, "tin", "tin"), (1, "large", "large"), (1, "red", "red"), (1, "bolt", "bolt")]


@query("greedy_names")
def greedy_names(spark, d):
    """Names in part texts, longest first and without overlap (no SQL counterpart; tested against brute force)."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return t(spark, d, "part").select("p_partkey", F.array_join(A.greedy_names(ALIASES)(text), "|").alias("names"))


@query("answer_diagnostics", r"""WITH w AS (SELECT conv_id, turn, role, coalesce(text, '') AS x, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ev FROM conversations), a AS (SELECT *, string_split(ev, ' ')[1:2] AS vs, list_transform(range(1, length(x) - 3), lambda i: substr(x, i, 5)) AS grams, len(string_split(x, ' ')) AS tokens FROM w WHERE role = 'assistant'),
c AS (SELECT *, list_transform(vs, lambda v: CASE WHEN v = '' THEN 0 ELSE (length(x) - length(replace(x, v, ''))) // length(v) END) AS ns FROM a)
SELECT conv_id, turn, round(coalesce(len(list_filter(grams, lambda g: contains(ev, g))) / nullif(len(grams), 0), 0), 6) AS copied, round(coalesce(list_sum(list_transform(ns, lambda n: greatest(0, n - 1))) / nullif(list_sum(ns), 0), 0), 6)::DOUBLE AS duplicate, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (tokens - 384) / 128)) AS verbose FROM c""")
def answer_diagnostics(spark, d):
    """Copied n-grams, repeated mentions of the first two words of the turn before, and length over budget of every answer."""
    before = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    a = t(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("x"), before.alias("ev")).where("role = 'assistant'")
    values = F.slice(F.split("ev", " "), 1, 2)
    return a.select("conv_id", "turn", F.round(A.copy_ratio(F.col("x"), F.col("ev")), 6).alias("copied"), F.round(A.duplicate_ratio(F.col("x"), values), 6).alias("duplicate"), A.verbosity(F.size(F.split("x", " "))).alias("verbose"))


@query("kl_summary", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p, list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS r, list_position(list_transform(embedding, lambda x: CAST(floor(abs(x) * 100) AS BIGINT)), 7) AS stop FROM embeddings WHERE embedding IS NOT NULL),
k AS (SELECT vec_id, list_transform(range(1, CASE WHEN stop > 0 THEN stop ELSE len(p) END + 1), lambda i: exp(r[i] - p[i]) - (r[i] - p[i]) - 1) AS kl FROM e), s AS (SELECT vec_id, kl, list_sort(kl) AS ks FROM k)
SELECT vec_id, len(kl) AS tokens, round(list_avg(kl), 6) AS mean, round(ks[CAST(ceil(0.5 * len(kl)) AS BIGINT)], 6) AS p50, round(ks[CAST(ceil(0.95 * len(kl)) AS BIGINT)], 6) AS p95, round(ks[len(kl)], 6) AS most FROM s""")
def kl_summary(spark, d):
    """Divergence of two token sequences up to the first end token: mean, nearest-rank percentiles and maximum."""
    e = t(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("p"), F.transform("embedding", lambda x: F.floor(F.abs(x) * 100)).alias("tokens"))
    k = e.select("vec_id", A.token_kl(F.col("p"), F.reverse("p"), F.col("tokens"), 7).alias("kl")).withColumn("ks", F.array_sort("kl"))
    n = F.size("kl")
    at = lambda q, name: F.round(F.element_at("ks", F.ceil(F.lit(q) * n).cast("int")), 6).alias(name)
    mean = F.aggregate("kl", F.lit(0.0), lambda a, x: a + x) / n
    return k.select("vec_id", n.cast("long").alias("tokens"), F.round(mean, 6).alias("mean"), at(0.5, "p50"), at(0.95, "p95"), at(1.0, "most"))


_METRIC_SQL = [
    ("tool_selection_accuracy", "count(*) FILTER (success AND NOT disallowed AND matched = mandatory)", "count(*)"),
    ("argument_validity", "count(*) FILTER (success AND matched = mandatory AND calls_valid)", "count(*)"),
    ("recommendation_hit_rate", "count(*) FILTER (success AND has_allowed AND hit)", "count(*) FILTER (has_allowed)"),
    ("hallucination_rate", "sum(unresolved)", "sum(declared)"),
    ("response_schema_validity", "count(*) FILTER (schema_valid AND undeclared = 0)", "count(*)"),
    ("declared_model_coverage", "sum(known) - sum(undeclared)", "sum(known)"),
    ("response_contract_consistency", "count(*) FILTER (schema_valid AND undeclared = 0)", "count(*)"),
    ("mandatory_tool_coverage", "coalesce(sum(matched) FILTER (success), 0)", "sum(mandatory)"),
]


@query("model_run_metrics", """WITH e AS (SELECT event_type AS et, value, CAST(props ->> 'k' AS INT) AS k FROM events), c AS (SELECT value < 200 AND et <> 'error' AS success, value < 200 AS schema_valid, et = 'purchase' AS disallowed, k % 5 <> 0 AS calls_valid, k % 2 = 0 AS has_allowed, k % 4 = 0 AS hit, k % 3 AS mandatory, least(k % 3, k % 4) AS matched, k % 3 AS declared, CASE WHEN k % 7 = 0 THEN k % 3 ELSE 0 END AS unresolved, k % 4 AS known, CASE WHEN k % 6 = 1 THEN k % 4 ELSE 0 END AS undeclared FROM e), m AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({a} AS BIGINT) AS num, CAST({b} AS BIGINT) AS den FROM c" for m, a, b in _METRIC_SQL) + """) SELECT metric, num, den, coalesce(round(num / nullif(den, 0), 6), 0.0::DOUBLE) AS ratio FROM m""")
def model_run_metrics(spark, d):
    """Eight ratios of a run, each with its own denominator."""
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("value") < 200
    cases = {
        "success": ok & (F.col("event_type") != "error"),
        "schema_valid": ok,
        "disallowed": F.col("event_type") == "purchase",
        "calls_valid": k % 5 != 0,
        "has_allowed": k % 2 == 0,
        "hit": k % 4 == 0,
        "mandatory": k % 3,
        "matched": F.least(k % 3, k % 4),
        "declared": k % 3,
        "unresolved": F.when(k % 7 == 0, k % 3).otherwise(0),
        "known": k % 4,
        "undeclared": F.when(k % 6 == 1, k % 4).otherwise(0),
    }
    return A.run_metrics(t(spark, d, "events").select(*(c.alias(name) for name, c in cases.items())))


@query("grounded_answers", """WITH a AS (SELECT p_partkey, CAST(p_partkey % 3 <> 0 AS BIGINT) AS size_ok, CAST(p_partkey % 5 <> 0 AS BIGINT) AS price_ok, 1 + p_partkey % 2 AS minimum, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS sourced FROM part),
s AS (SELECT *, size_ok + price_ok AS matched, 2 - size_ok - price_ok AS unsupported, least(1.0::DOUBLE, (size_ok + price_ok) / minimum) AS coverage, CASE WHEN size_ok + price_ok > 0 THEN (size_ok * sourced + price_ok) / (size_ok + price_ok) ELSE 0.0::DOUBLE END AS integrity FROM a)
SELECT p_partkey, matched, unsupported, round(matched / 2, 6) AS precision, round(coverage, 6) AS coverage, round(integrity, 6) AS integrity, CASE WHEN matched >= minimum THEN round(0.45::DOUBLE * (matched / 2) + 0.30::DOUBLE * coverage + 0.15::DOUBLE * integrity + 0.10::DOUBLE, 6) ELSE 0.0::DOUBLE END AS total FROM s""")
def grounded_answers(spark, d):
    """Answers about part sizes and prices, a third and a fifth of them wrong, scored against their claims."""
    k, price = F.col("p_partkey"), F.floor("p_retailprice")
    off = lambda n: F.when(k % n == 0, 1).otherwise(0)
    part = t(spark, d, "part")
    answer = F.concat_ws("", "p_brand", F.lit(" size is "), (F.col("p_size") + off(3)).cast("string"), F.lit("; "), "p_brand", F.lit(" price is "), (price + off(5)).cast("string"), F.lit(". Thanks"))
    answers = part.select("p_partkey", answer.alias("answer"), (1 + k % 2).alias("minimum"))
    claim = lambda name, value, locator: F.struct(F.lit(name).alias("attribute"), value.cast("string").alias("value"), locator.alias("locator"))
    facts = F.array(claim("size", F.col("p_size"), F.when(k % 7 == 0, "").otherwise("row")), claim("price", price, F.lit("row")))
    claims = part.select("p_partkey", F.col("p_brand").alias("entity"), F.lit("lookup").alias("tool"), F.explode(facts).alias("f")).select("p_partkey", "entity", "tool", "f.*")
    g = A.grounded_score(answers, claims, "p_partkey")
    return g.select("p_partkey", "matched", "unsupported", *(F.round(c, 6).alias(c) for c in ("precision", "coverage", "integrity", "total")))
