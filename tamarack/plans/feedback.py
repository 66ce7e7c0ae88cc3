"""Feedback summaries, rules and their application; governance and host trust."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators import feedback as B
from tamarack.plans.registry import query
from tamarack.session import table as t

NOW = "2024-03-01 00:00:00"


def _fb(spark, d):
    return B.events_as_feedback(t(spark, d, "events"))


def _summary(df, key):
    n = lambda r: F.count_if(F.col("rating") == r)
    return df.groupBy(key).agg(F.count("*").alias("n"), n("positive").alias("pos"), n("negative").alias("neg"), F.round(n("positive") * 100.0 / F.count("*"), 1).alias("rate"))


def _summary_sql(key, source="fb"):
    return f"SELECT {key}, count(*) AS n, count(*) FILTER (rating = 'positive') AS pos, count(*) FILTER (rating = 'negative') AS neg, round(count(*) FILTER (rating = 'positive') * 100.0::DOUBLE / count(*), 1) AS rate FROM {source} GROUP BY {key}"


@query("feedback_summary_model", f"WITH {B.FEEDBACK_SQL} SELECT * FROM ({_summary_sql('model')}) ORDER BY n DESC, model LIMIT 10")
def feedback_summary_model(spark, d):
    return _summary(_fb(spark, d), "model").orderBy(F.desc("n"), "model").limit(10)


@query("feedback_summary_pool", f"WITH {B.FEEDBACK_SQL} {_summary_sql('pool')}")
def feedback_summary_pool(spark, d):
    return _summary(_fb(spark, d), "pool")


@query("feedback_summary_scene", f"WITH {B.FEEDBACK_SQL}, s AS (SELECT unnest(scenes) AS scene, rating FROM fb) {_summary_sql('scene', 's')}")
def feedback_summary_scene(spark, d):
    return _summary(_fb(spark, d).select(F.explode_outer("scenes").alias("scene"), "rating"), "scene")


@query("feedback_recent_500", f"WITH {B.FEEDBACK_SQL}, r AS (SELECT * FROM fb ORDER BY event_id DESC LIMIT 500) {_summary_sql('event_type', 'r')}")
def feedback_recent_500(spark, d):
    return _summary(_fb(spark, d).orderBy(F.desc("event_id")).limit(500), "event_type")


@query("feedback_recency_weighted", f"WITH {B.FEEDBACK_SQL}, w AS ({B.weighted_sql('pool', NOW)}) SELECT pool, n, round(w, 2) AS w, round(pos, 2) AS pos, round(neg, 2) AS neg, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest, {B.CONFIDENCE_SQL} AS confidence FROM w")
def feedback_recency_weighted(spark, d):
    w = B.weighted(_fb(spark, d), ["pool"], NOW)
    return w.select("pool", "n", F.round("w", 2).alias("w"), F.round("pos", 2).alias("pos"), F.round("neg", 2).alias("neg"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), B.confidence(F.col("n"), F.col("w")).alias("confidence"))


RULES_SQL = f"""w AS ({B.weighted_sql('model', NOW)}), n0 AS (SELECT *, (pos - neg) / greatest(w, 0.1::DOUBLE) AS net, {B.CONFIDENCE_SQL} AS confidence FROM w WHERE n >= 3),
rules AS (SELECT model, round(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, net * 8 * confidence)), 1) AS delta, confidence FROM n0 WHERE abs(net) >= 0.2)"""


@query("feedback_rules", f"WITH {B.FEEDBACK_SQL}, {RULES_SQL} SELECT * FROM rules WHERE delta <> 0")
def feedback_rules(spark, d):
    return B.model_rules(B.weighted(_fb(spark, d), ["model"], NOW))


@query("feedback_pool_rules", f"""WITH {B.FEEDBACK_SQL}, w AS ({B.weighted_sql('pool', NOW)}), r AS (SELECT *, pos * 100 / greatest(w, 0.1::DOUBLE) AS rate, {B.CONFIDENCE_SQL} AS confidence FROM w WHERE n >= 5)
SELECT pool, round(CASE WHEN rate < 55 THEN -3 * confidence WHEN rate >= 80 THEN 2.1::DOUBLE * confidence END, 2) AS delta FROM r WHERE rate < 55 OR rate >= 80""")
def feedback_pool_rules(spark, d):
    w = B.weighted(_fb(spark, d), ["pool"], NOW).where("n >= 5").withColumn("rate", F.col("pos") * 100 / F.greatest(F.col("w"), F.lit(0.1)))
    c = B.confidence(F.col("n"), F.col("w"))
    return w.where("rate < 55 or rate >= 80").select("pool", F.round(F.when(F.col("rate") < 55, -3 * c).otherwise(2.1 * c), 2).alias("delta"))


@query("risky_scenes", f"""WITH {B.FEEDBACK_SQL}, fb2 AS (SELECT unnest(scenes) AS scene, * EXCLUDE (scenes) FROM fb), w AS ({B.weighted_sql('scene', NOW).replace('FROM fb', 'FROM fb2')})
SELECT scene, n, round(neg * 100 / w, 1) AS rate FROM w WHERE n >= 2 AND neg * 100 / w >= 18 ORDER BY round(neg * 100 / w, 1) DESC, n DESC, scene LIMIT 5""")
def risky_scenes(spark, d):
    w = B.weighted(_fb(spark, d).withColumn("scene", F.explode("scenes")), ["scene"], NOW)
    rate = F.col("neg") * 100 / F.col("w")
    return w.where((F.col("n") >= 2) & (rate >= 18)).select("scene", "n", F.round(rate, 1).alias("rate")).orderBy(F.desc("rate"), F.desc("n"), "scene").limit(5)


@query("feedback_apply", f"""WITH {B.FEEDBACK_SQL}, {RULES_SQL}, base AS (SELECT p_partkey, p_type, p_size * 2.0::DOUBLE AS score, p_partkey % 100 AS model FROM part),
a AS (SELECT p_partkey, p_type, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, score + coalesce(delta, 0))), 1) AS adjusted, score FROM base LEFT JOIN (SELECT * FROM rules WHERE delta <> 0) r ON base.model = r.model)
SELECT p_type, p_partkey, adjusted, CAST(row_number() OVER (PARTITION BY p_type ORDER BY adjusted DESC, score DESC, p_partkey) AS INT) AS rank FROM a QUALIFY rank <= 5""")
def feedback_apply(spark, d):
    """Scores shifted by the rules, clipped, re-ranked; earlier order breaks ties."""
    rules = B.model_rules(B.weighted(_fb(spark, d), ["model"], NOW))
    base = t(spark, d, "part").select("p_partkey", "p_type", (F.col("p_size") * 2.0).alias("score"), (F.col("p_partkey") % 100).alias("model"))
    a = base.join(rules, "model", "left").withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + F.coalesce("delta", F.lit(0.0)))), 1))
    rank = F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("adjusted"), F.desc("score"), "p_partkey"))
    return a.withColumn("rank", rank).where("rank <= 5").select("p_type", "p_partkey", "adjusted", "rank")


# ---------------------------------------------------------------- governance


@query("governance_duplicates", """SELECT lower(trim(p_brand)) || '|' || lower(trim(p_name)) || '|' || CAST(p_size % 5 AS VARCHAR) AS k, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY k HAVING count(*) > 1""")
def governance_duplicates(spark, d):
    k = F.concat_ws("|", F.lower(F.trim("p_brand")), F.lower(F.trim("p_name")), (F.col("p_size") % 5).cast("string"))
    return t(spark, d, "part").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query("governance_missing", """SELECT field, count(*) FILTER (trim(coalesce(v, '')) = '') AS missing, count(*) AS n FROM (SELECT unnest(['text', 'lang', 'source', 'title']) AS field, unnest([text, lang, source, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'x' END]) AS v FROM documents) GROUP BY field""")
def governance_missing(spark, d):
    docs = t(spark, d, "documents").withColumn("title", F.when(F.col("doc_id") % 11 == 0, " ").otherwise("x"))
    return docs.unpivot([], ["text", "lang", "source", "title"], "field", "v").groupBy("field").agg(F.count_if(F.trim(F.coalesce("v", F.lit(""))) == "").alias("missing"), F.count("*").alias("n"))


@query("governance_anomalies", """SELECT p_partkey, rule FROM (SELECT p_partkey, unnest([CASE WHEN p_size <> 0 AND (p_size < 3 OR p_size > 48) THEN 'size' END, CASE WHEN p_retailprice > 995 THEN 'price' END, CASE WHEN p_partkey % 97 = 13 THEN 'year' END]) AS rule FROM part) WHERE rule IS NOT NULL""")
def governance_anomalies(spark, d):
    rules = F.array_compact(F.array(F.when((F.col("p_size") != 0) & ((F.col("p_size") < 3) | (F.col("p_size") > 48)), "size"), F.when(F.col("p_retailprice") > 995, "price"), F.when(F.col("p_partkey") % 97 == 13, "year")))
    return t(spark, d, "part").select("p_partkey", F.explode(rules).alias("rule"))


HOST_SQL = "replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), 'www.', '')"


def host(url):
    """Lower-case host without port, with ``www.`` removed."""
    return F.replace(F.lower(F.parse_url(url, F.lit("HOST"))), F.lit("www."), F.lit(""))


@query("host_trust", f"""SELECT host, count(*) AS n, max(CASE WHEN ends_with(host, 'example.org') OR ends_with(host, 'th.example.net') THEN 95 WHEN ends_with(host, 'example.net') THEN 75 ELSE 40 END) AS trust FROM (SELECT {HOST_SQL} AS host FROM pages) GROUP BY host""")
def host_trust(spark, d):
    h = F.col("host")
    trust = F.when(h.endswith("example.org") | h.endswith("th.example.net"), 95).when(h.endswith("example.net"), 75).otherwise(40)
    return t(spark, d, "pages").select(host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"), F.max(trust).alias("trust"))


@query("governance_score", """WITH k AS (SELECT count(*) AS groups FROM (SELECT lower(p_brand) || p_name || CAST(p_size AS VARCHAR) AS k FROM part GROUP BY k HAVING count(*) > 1)),
a AS (SELECT count(*) AS n, count(*) FILTER (p_size % 7 = 0) AS missing, count(*) FILTER (p_retailprice > 995) AS anomalies, avg(CASE WHEN p_partkey % 10 = 0 THEN 40 ELSE 95 END) AS trust FROM part)
SELECT n, groups, missing, anomalies, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - least(25.0::DOUBLE, groups * 100.0::DOUBLE / n) - least(25.0::DOUBLE, missing * 100.0::DOUBLE / (9 * n)) - least(20.0::DOUBLE, anomalies * 100.0::DOUBLE / n) + least(10.0::DOUBLE, (trust - 70) / 3))), 1) AS score FROM a, k""")
def governance_score(spark, d):
    """Composite quality score; duplicate groups (not rows), missing cells, anomalies, and a bonus that can be negative."""
    parts = t(spark, d, "part")
    k = parts.groupBy(F.concat(F.lower("p_brand"), "p_name", F.col("p_size").cast("string")).alias("k")).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("groups"))
    a = parts.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") % 7 == 0).alias("missing"), F.count_if(F.col("p_retailprice") > 995).alias("anomalies"), F.avg(F.when(F.col("p_partkey") % 10 == 0, 40).otherwise(95)).alias("trust"))
    n = F.col("n")
    score = 100.0 - F.least(F.lit(25.0), F.col("groups") * 100.0 / n) - F.least(F.lit(25.0), F.col("missing") * 100.0 / (9 * n)) - F.least(F.lit(20.0), F.col("anomalies") * 100.0 / n) + F.least(F.lit(10.0), (F.col("trust") - 70) / 3)
    return a.crossJoin(k).select("n", "groups", "missing", "anomalies", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("score"))


@query("catalog_overview", """SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, count(DISTINCT p_brand || '|' || p_name) AS models, min(p_size) AS least, max(p_size) AS most, round(avg(CASE WHEN p_size > 10 THEN p_size END), 4) AS mean_positive FROM part""")
def catalog_overview(spark, d):
    return t(spark, d, "part").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"), F.countDistinct(F.concat_ws("|", "p_brand", "p_name")).alias("models"), F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.round(F.avg(F.when(F.col("p_size") > 10, F.col("p_size"))), 4).alias("mean_positive"))


@query("gate_scores", """WITH c AS (SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM part), 100, 'ge', TRUE), ('brands', (SELECT count(DISTINCT p_brand) FROM part), 20, 'ge', FALSE), ('docs', (SELECT count(*) FROM documents), 1000000, 'ge', TRUE), ('pages', (SELECT count(*) FROM pages), 100000, 'le', FALSE)) x(name, value, threshold, op, blocker)),
p AS (SELECT *, CASE WHEN op = 'ge' THEN value >= threshold ELSE value <= threshold END AS passed FROM c)
SELECT count(*) AS checks, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 1) AS readiness, count(*) FILTER (NOT passed AND blocker) AS blockers, CASE WHEN count(*) FILTER (NOT passed AND blocker) > 0 THEN 'blocked' ELSE 'ready' END AS state, round(0.55::DOUBLE * (count(*) FILTER (passed) * 100.0::DOUBLE / count(*)) + 0.45::DOUBLE * 80, 1) AS acceptance FROM p""")
def gate_scores(spark, d):
    """Checks against thresholds: readiness, blockers and the weighted acceptance score."""
    one = lambda name, value, threshold, op, blocker, df: df.agg(value.alias("value")).select(F.lit(name).alias("name"), "value", F.lit(threshold).alias("threshold"), F.lit(op).alias("op"), F.lit(blocker).alias("blocker"))
    parts = t(spark, d, "part")
    c = one("rows", F.count("*"), 100, "ge", True, parts).union(one("brands", F.countDistinct("p_brand"), 20, "ge", False, parts)).union(one("docs", F.count("*"), 1000000, "ge", True, t(spark, d, "documents"))).union(one("pages", F.count("*"), 100000, "le", False, t(spark, d, "pages")))
    p = c.withColumn("passed", F.when(F.col("op") == "ge", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))
    share = F.count_if("passed") * 100.0 / F.count("*")
    blockers = F.count_if(~F.col("passed") & F.col("blocker"))
    return p.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.round(share, 1).alias("readiness"), blockers.alias("blockers"), F.when(blockers > 0, "blocked").otherwise("ready").alias("state"), F.round(0.55 * share + 0.45 * 80, 1).alias("acceptance"))


@query("weakest_pool", f"WITH {B.FEEDBACK_SQL}, s AS ({_summary_sql('pool')}) SELECT pool, rate, n FROM s ORDER BY rate, n DESC, pool LIMIT 1")
def weakest_pool(spark, d):
    return _summary(_fb(spark, d), "pool").select("pool", "rate", "n").orderBy("rate", F.desc("n"), "pool").limit(1)


@query("optimization_items", f"""WITH {B.FEEDBACK_SQL}, s AS ({_summary_sql('pool')}) SELECT pool AS item, CASE WHEN rate < 19 THEN 'P0' WHEN rate < 20 THEN 'P1' ELSE 'P2' END AS priority, CASE WHEN rate < 19 THEN 100 WHEN rate < 20 THEN 85 ELSE 65 END AS weight FROM s
UNION ALL SELECT 'duplicates', 'P3', 45 FROM (SELECT count(*) - count(DISTINCT text) AS n FROM documents) WHERE n > 0""")
def optimization_items(spark, d):
    rate = F.col("rate")
    s = _summary(_fb(spark, d), "pool").select(F.col("pool").alias("item"), F.when(rate < 19, "P0").when(rate < 20, "P1").otherwise("P2").alias("priority"), F.when(rate < 19, 100).when(rate < 20, 85).otherwise(65).alias("weight"))
    dup = t(spark, d, "documents").agg((F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("n")).where("n > 0").select(F.lit("duplicates"), F.lit("P3"), F.lit(45))
    return s.union(dup)
