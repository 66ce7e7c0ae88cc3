"""Grounding audit with its pressure test, risks and scenario checks of the ranked rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.operators import audit as A
from tamarack.operators import profile as P
from tamarack.operators import rank as R
from tamarack.plans import profiles
from tamarack.plans.registry import query
from tamarack.session import table as t

_CASES_SQL = "b AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS price, 300 + p_size AS far FROM part)"


def _answers(spark, d):
    """A good and a bad answer about every part; every fourth bad one says nothing wrong."""
    k, price, far = F.col("p_partkey"), F.floor("p_retailprice").cast("string"), (300 + F.col("p_size")).cast("string")
    evidence = F.concat(F.lit("售价 "), price, F.lit("万，续航 "), far, F.lit("公里，来源《公开手册》"))
    good = F.concat(F.lit("售价 "), price, F.lit(".0 万元，续航"), far, F.lit(" km。提供的保修政策以官方公布为准。参考《公开手册》"))
    wrong = F.concat(F.lit("售价"), (F.floor("p_retailprice") + 1).cast("string"), F.lit("万，续航 "), far, F.lit(" km；提供终身免费保修；来源《内部资料》[1]"))
    answers = F.array(F.struct(F.lit("good").alias("variant"), good.alias("answer")), F.struct(F.lit("bad").alias("variant"), F.when(k % 4 == 0, good).otherwise(wrong).alias("answer")))
    a = t(spark, d, "part").select("p_partkey", evidence.alias("evidence"), F.explode(answers).alias("a")).select("p_partkey", "evidence", "a.*")
    return a.select("p_partkey", "variant", A.grounding_errors(F.col("answer"), F.col("evidence")).alias("errors"))


@query("grounding_audit", f"""WITH {_CASES_SQL}, v AS (SELECT *, unnest(['good', 'bad']) AS variant FROM b) SELECT p_partkey, variant, CASE WHEN variant = 'good' OR p_partkey % 4 = 0 THEN '' ELSE 'unsupported hard claim: ' || CAST(price + 1 AS VARCHAR) || '万; unsupported quoted source: 内部资料; unsupported bracket citation: [1]; unsupported policy claim: 提供终身免费保修' END AS errors FROM v""")
def grounding_audit(spark, d):
    """Claims of answers that their evidence does not have."""
    return _answers(spark, d).withColumn("errors", F.array_join("errors", "; "))


@query("grounding_pressure", """SELECT 2 * count(*) AS cases, CAST(0 AS BIGINT) AS false_positives, count(*) FILTER (p_partkey % 4 = 0) AS false_negatives, count(*) FILTER (p_partkey % 4 = 0) = 0 AS passed FROM part""")
def grounding_pressure(spark, d):
    """Good answers must pass the audit and bad ones fail."""
    return A.confusion(_answers(spark, d), F.col("variant") == "good")


RANKED_SQL = f"{R.CATALOG_SQL}, {R.PROFILE_SQL}, s AS (SELECT c_custkey, p_partkey, p_type, price, energy, safety, monthly_sales, {R.SCORE_SQL} AS raw FROM prof JOIN cat ON p_type = pref_type AND price <= budget * 1.25), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY raw DESC, monthly_sales DESC, p_partkey) AS rank FROM s QUALIFY rank <= 5)"


def _ranked(spark, d):
    rows = R.catalog(t(spark, d, "part")).select("p_partkey", "p_type", "price", "energy", "safety")
    return R.rank_profiles(t(spark, d, "customer"), t(spark, d, "part")).join(rows, "p_partkey")


@query("risk_checks", f"""WITH {RANKED_SQL}, g AS (SELECT c_custkey, count(rank) AS n, bool_and(price > budget) FILTER (rank <= 3) AS dear, count(*) FILTER (rank <= 3 AND energy = 'electric' AND home_charger = FALSE) AS electric, count(*) FILTER (safety < 85) AS low, count(*) FILTER (p_partkey % 6 = 0) AS cautions FROM prof LEFT JOIN r USING (c_custkey) GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN n = 0 THEN 'no candidates' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN dear THEN 'over budget' END, CASE WHEN electric >= 2 THEN 'electric without charger' END, CASE WHEN low > 0 THEN 'low data quality' END, CASE WHEN cautions > 0 THEN 'cautions' END), ''), 'none') END AS risks FROM g""")
def risk_checks(spark, d):
    """Risks of the best five rows of every customer."""
    ranked = _ranked(spark, d).select("c_custkey", "rank", "price", "energy", F.col("safety").alias("quality"), F.when(F.col("p_partkey") % 6 == 0, 1).otherwise(0).alias("cautions"))
    return A.risk_checks(R.profiles(t(spark, d, "customer")), ranked, "c_custkey").withColumn("risks", F.array_join("risks", "; "))


@query("scenario_checks", f"""WITH {RANKED_SQL}, g AS (SELECT c_custkey, count(*) FILTER (p_partkey % 7 = c_custkey % 7) AS hits, bool_or(rank <= 3 AND energy = CASE WHEN c_custkey % 2 = 0 THEN 'electric' ELSE 'plugin' END) AS energy_ok, bool_or(p_type = pref_type AND rank <= 3) AS type_ok, bool_or(rank <= 2 AND p_partkey % 7 = 1) AS pair_ok FROM prof LEFT JOIN r USING (c_custkey) GROUP BY c_custkey),
c AS (SELECT c_custkey, CASE WHEN hits > 0 THEN 1 ELSE 0 END + CASE WHEN energy_ok THEN 1 ELSE 0 END + CASE WHEN type_ok THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 AND pair_ok THEN 1 ELSE 0 END AS passed, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 3 END AS checks FROM g)
SELECT c_custkey, CAST(passed AS INT) AS passed, CAST(checks AS INT) AS checks, round(passed / checks * 100, 1) AS score, CASE WHEN round(passed / checks * 100, 1) >= 85 THEN 'pass' WHEN round(passed / checks * 100, 1) >= 70 THEN 'warn' ELSE 'fail' END AS status FROM c""")
def scenario_checks(spark, d):
    """Expectations of every customer, with part keys modulo 7 as names: score and status."""
    k = F.col("c_custkey")
    cases = R.profiles(t(spark, d, "customer")).select(
        "c_custkey", F.array(k % 7).alias("model_any"), F.when(k % 3 == 0, F.array(F.lit(1).cast("long"))).alias("top_all"),
        F.array(F.when(k % 2 == 0, "electric").otherwise("plugin")).alias("energy_any"), F.array("pref_type").alias("type_any"),
    )
    ranked = _ranked(spark, d).select("c_custkey", "rank", (F.col("p_partkey") % 7).alias("name"), "energy", F.col("p_type").alias("type"))
    return A.scenario_checks(cases, ranked, "c_custkey")


@query("explain_top", f"""WITH {RANKED_SQL}, {profiles.PROFILE_SQL}, m AS (SELECT r.c_custkey, rank, r.p_type, home_charger, concerns, 2000 - cat.price AS budget, cat.wheelbase AS space, cat.range_km AS charging FROM r JOIN cat USING (p_partkey) JOIN (SELECT c_custkey, concerns, has_home_charger AS home_charger FROM p) q ON q.c_custkey = r.c_custkey WHERE rank <= 3),
o AS (SELECT x.c_custkey, x.rank, count(y.rank) AS others, coalesce(max(y.budget), -1) AS b, coalesce(max(y.space), -1) AS s, coalesce(max(y.charging), -1) AS c FROM m x LEFT JOIN m y ON x.c_custkey = y.c_custkey AND x.rank <> y.rank GROUP BY ALL)
SELECT c_custkey, CAST(rank AS INT) AS rank, CASE WHEN list_contains(concerns, '空间') AND p_type = 'LARGE' THEN 'space' WHEN list_contains(concerns, '补能') OR coalesce(NOT home_charger, FALSE) THEN 'charging' WHEN list_contains(concerns, '智驾') THEN 'assistance' ELSE 'balance' END AS best_for,
CASE WHEN others = 0 THEN 'too few' ELSE concat_ws('|', CASE WHEN budget >= b THEN 'budget' END, CASE WHEN space >= s THEN 'space' END, CASE WHEN charging >= c THEN 'charging' END) END AS stronger FROM m JOIN o USING (c_custkey, rank)""")
def explain_top(spark, d):
    """What the three best rows of every customer suit, and where none of the others is better."""
    rows = R.catalog(t(spark, d, "part")).select("p_partkey", F.col("p_type").alias("type"), (2000 - F.col("price")).alias("budget"), F.col("wheelbase").alias("space"), F.col("range_km").alias("charging"))
    asked = P.with_profile(profiles.questions(spark, d), cities=profiles.CITIES).select("c_custkey", "concerns", F.col("has_home_charger").alias("home_charger"))
    ranked = R.rank_profiles(t(spark, d, "customer"), t(spark, d, "part"), k=3).join(rows, "p_partkey").join(asked, "c_custkey")
    return A.explain_top(ranked, "c_custkey", ("LARGE",)).withColumn("stronger", F.array_join("stronger", "|"))
