"""Ranking, recall, resolution, imputation and catalog queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators import rank as R
from tamarack.plans.registry import query
from tamarack.session import table as t

BOTH = f"{R.CATALOG_SQL}, {R.PROFILE_SQL}"


@query("rank_topk_profiles", f"""WITH {BOTH}, s AS (SELECT c_custkey, p_partkey, monthly_sales, {R.SCORE_SQL} AS raw FROM prof JOIN cat ON p_type = pref_type AND price <= budget * 1.25)
SELECT c_custkey, rank, p_partkey, round(raw, 1) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY raw DESC, monthly_sales DESC, p_partkey) AS INT) AS rank FROM s) WHERE rank <= 5""")
def rank_topk_profiles(spark, d):
    return R.rank_profiles(t(spark, d, "customer"), t(spark, d, "part"))


@query("tool_rank_tiebreak", f"""WITH {R.CATALOG_SQL}, p AS (SELECT *, 930.0::DOUBLE AS budget, 4 AS family, 40 AS commute, 'LARGE' AS pref_type, TRUE AS home_charger FROM cat WHERE energy IN ('plugin', 'extender')),
s AS (SELECT *, CASE energy WHEN 'plugin' THEN 0 ELSE 1 END AS energy_rank, greatest(0.0::DOUBLE, least(100.0::DOUBLE, {R.SCORE_SQL} - least(5 * abs(price - budget) / budget, 6.0::DOUBLE) - CASE WHEN energy = 'plugin' THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END)) AS raw FROM p)
SELECT p_partkey, energy_rank, round(raw, 2) AS score, CAST(row_number() OVER (ORDER BY energy_rank, raw DESC, price, p_brand, p_name, p_partkey) AS INT) AS rank FROM s QUALIFY rank <= 20""")
def tool_rank_tiebreak(spark, d):
    """Adjusted score of one profile (plug-in preferred, extenders as second choice), five sort keys and the id."""
    p = R.catalog(t(spark, d, "part")).where(F.col("energy").isin("plugin", "extender")).select("*", F.lit(930.0).alias("budget"), F.lit(4).alias("family"), F.lit(40).alias("commute"), F.lit("LARGE").alias("pref_type"), F.lit(True).alias("home_charger"))
    adjusted = R.weighted_score() - F.least(5 * F.abs(F.col("price") - F.col("budget")) / F.col("budget"), F.lit(6.0)) - F.when(F.col("energy") == "plugin", 0.0).otherwise(4.0)
    s = p.withColumn("energy_rank", F.when(F.col("energy") == "plugin", 0).otherwise(1)).withColumn("raw", F.greatest(F.lit(0.0), F.least(F.lit(100.0), adjusted)))
    best = s.orderBy("energy_rank", F.desc("raw"), "price", "p_brand", "p_name", "p_partkey").limit(20)
    return best.select("p_partkey", "energy_rank", F.round("raw", 2).alias("score"), F.row_number().over(W.orderBy("energy_rank", F.desc("raw"), "price", "p_brand", "p_name", "p_partkey")).alias("rank"))


@query("recall_with_fallback", """WITH n AS (SELECT n_nationkey, 895.0::DOUBLE + n_nationkey AS top, CASE WHEN n_nationkey % 5 = 0 THEN 'NO SUCH' ELSE 'LARGE' END AS wanted FROM nation),
p AS (SELECT * FROM n JOIN part ON p_size = n_nationkey + 1), h AS (SELECT *, p_retailprice <= top * 1.05::DOUBLE AND p_type LIKE '%' || wanted || '%' AS hit FROM p)
SELECT n_nationkey, p_partkey, hit FROM (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY n_nationkey) AS any_hit FROM h) WHERE hit OR any_hit = 0""")
def recall_with_fallback(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", (F.lit(895.0) + F.col("n_nationkey")).alias("top"), F.when(F.col("n_nationkey") % 5 == 0, "NO SUCH").otherwise("LARGE").alias("wanted"))
    pairs = n.join(t(spark, d, "part"), F.col("p_size") == F.col("n_nationkey") + 1)
    hit = (F.col("p_retailprice") <= F.col("top") * 1.05) & F.contains("p_type", "wanted")
    return R.recall(pairs.withColumn("hit", hit), ["n_nationkey"], F.col("hit")).select("n_nationkey", "p_partkey", "hit")


@query("fused_union_dedupe", """WITH u AS (SELECT 0 AS source_rank, p_partkey AS id, lower(regexp_replace(p_brand || p_name, '[^A-Za-z0-9]', '', 'g')) AS k FROM part
UNION ALL SELECT 1, s_suppkey + 1000000, lower(regexp_replace('Brand#' || CAST(s_suppkey % 30 AS VARCHAR) || 'red bolt', '[^A-Za-z0-9]', '', 'g')) FROM supplier)
SELECT k AS catalog_key, arg_min(id, source_rank * 10000000 + id) AS id, min(source_rank) AS source_rank FROM u GROUP BY k""")
def fused_union_dedupe(spark, d):
    clean = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    local = t(spark, d, "part").select(F.col("p_partkey").alias("id"), clean(F.concat("p_brand", "p_name")).alias("catalog_key"))
    real = t(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), clean(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string"), F.lit("red bolt"))).alias("catalog_key"))
    return R.union_first_wins([local, real], F.col("catalog_key"), ["id"]).select("catalog_key", "id", "source_rank")


@query("fused_quota_topk", """WITH s AS (SELECT p_type, p_partkey, CASE WHEN p_size < 6 THEN 'real' ELSE 'local' END AS source, p_retailprice - CASE WHEN p_size < 6 THEN 2 + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END ELSE 0 END AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS place, row_number() OVER (PARTITION BY p_type, source ORDER BY score DESC, p_partkey) AS own FROM s),
f AS (SELECT *, max(CASE WHEN source = 'real' AND place <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY p_type) AS inside, max(CASE WHEN source = 'real' THEN 1 ELSE 0 END) OVER (PARTITION BY p_type) AS there FROM r)
SELECT p_type, p_partkey, source, round(score, 2) AS score, CAST(least(place, 5) AS INT) AS rank FROM f WHERE CASE WHEN inside = 0 AND there = 1 THEN place < 5 OR (source = 'real' AND own = 1) ELSE place <= 5 END""")
def fused_quota_topk(spark, d):
    real = F.col("p_size") < 6
    penalty = F.when(real, 2 + F.when(F.col("p_partkey") % 2 == 0, 5).otherwise(0)).otherwise(0)
    s = t(spark, d, "part").select("p_type", "p_partkey", F.when(real, "real").otherwise("local").alias("source"), (F.col("p_retailprice") - penalty).alias("score"))
    return R.with_source_quota(s, ["p_type"], "source", "real", [F.desc("score"), "p_partkey"], 5).select("p_type", "p_partkey", "source", F.round("score", 2).alias("score"), "rank")


@query("mention_match", """WITH a AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS priority FROM (SELECT DISTINCT p_name FROM part)),
m AS (SELECT c.c_custkey, a.p_name, a.priority FROM (SELECT c_custkey, 'ask ' || p_name || ' or Red Bolt' AS query FROM customer JOIN part ON p_partkey = c_custkey % 200) c JOIN a ON contains(replace(lower(c.query), ' ', ''), replace(a.p_name, ' ', '')))
SELECT c_custkey, string_agg(p_name, ',' ORDER BY priority) AS mentions, count(*) AS n FROM m GROUP BY c_custkey""")
def mention_match(spark, d):
    """Names of a small alias dimension found inside free texts with spaces removed; a broadcast theta join over distinct texts."""
    parts = t(spark, d, "part")
    alias = parts.select("p_name").distinct().withColumn("priority", F.row_number().over(W.orderBy("p_name")))
    asks = t(spark, d, "customer").join(parts, F.col("p_partkey") == F.col("c_custkey") % 200).select("c_custkey", F.replace(F.lower(F.concat(F.lit("ask "), F.col("p_name"), F.lit(" or Red Bolt"))), F.lit(" "), F.lit("")).alias("ask"))
    hits = asks.select("ask").distinct().join(F.broadcast(alias), F.contains("ask", F.replace("p_name", F.lit(" "), F.lit(""))))
    found = hits.groupBy("ask").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "p_name"))), lambda x: x["p_name"]), ",").alias("mentions"), F.count("*").alias("n"))
    return asks.join(found, "ask").select("c_custkey", "mentions", "n")


@query("tiered_resolve", """WITH ask AS (SELECT DISTINCT lower(p_brand) AS q FROM part UNION SELECT 'small ring' UNION SELECT 'brand#1' UNION SELECT 'nothing'),
m AS (SELECT q, p_partkey, CASE WHEN lower(p_brand) || ' ' || p_name = q THEN 1 WHEN p_name = q THEN 2 WHEN contains(lower(p_brand) || ' ' || p_name, q) THEN 3 END AS tier FROM ask JOIN part ON contains(lower(p_brand) || ' ' || p_name, q)),
b AS (SELECT q, p_partkey, tier FROM (SELECT *, min(tier) OVER (PARTITION BY q) AS best FROM m) WHERE tier = best)
SELECT q, min(tier) AS tier, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS resolved FROM b GROUP BY q""")
def tiered_resolve(spark, d):
    """Best tier only (full name, model, part of the name); an ambiguous tier resolves to null."""
    parts = t(spark, d, "part")
    literal = spark.createDataFrame([("small ring",), ("brand#1",), ("nothing",)], "q string")
    ask = parts.select(F.lower("p_brand").alias("q")).union(literal).distinct()
    full = F.concat(F.lower("p_brand"), F.lit(" "), F.col("p_name"))
    m = parts.join(F.broadcast(ask), F.contains(full, F.col("q"))).withColumn("tier", F.when(full == F.col("q"), 1).when(F.col("p_name") == F.col("q"), 2).otherwise(3))
    best = m.withColumn("best", F.min("tier").over(W.partitionBy("q"))).where("tier = best")
    return best.groupBy("q").agg(F.min("tier").alias("tier"), F.count("*").alias("n"), F.min("p_partkey").alias("one")).select("q", "tier", "n", F.when(F.col("n") == 1, F.col("one")).alias("resolved"))


@query("hot_items", """SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS units, count(*) AS lines FROM lineitem GROUP BY l_partkey ORDER BY units DESC, l_partkey LIMIT 12""")
def hot_items(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("units"), F.count("*").alias("lines")).orderBy(F.desc("units"), "l_partkey").limit(12)


@query("price_impute", """SELECT p_partkey, CAST(floor((CASE WHEN CAST(substr(p_brand, 7) AS INT) <= 8 THEN 300000 WHEN CAST(substr(p_brand, 7) AS INT) <= 16 THEN 200000 ELSE 120000 END + CASE WHEN p_type = 'LARGE' THEN 30000 ELSE 0 END + least(p_size, 40) * 900 + CASE WHEN contains(p_name, 'n') THEN 12000 ELSE 0 END) / 1000) * 1000 AS BIGINT) AS price FROM part""")
def price_impute(spark, d):
    brand = F.substring("p_brand", 7, 9).cast("int")
    raw = F.when(brand <= 8, 300000).when(brand <= 16, 200000).otherwise(120000) + F.when(F.col("p_type") == "LARGE", 30000).otherwise(0) + F.least(F.col("p_size"), F.lit(40)) * 900 + F.when(F.contains("p_name", F.lit("n")), 12000).otherwise(0)
    return t(spark, d, "part").select("p_partkey", (F.floor(raw / 1000) * 1000).cast("long").alias("price"))


@query("completeness_score", """SELECT p_partkey, round(100.0::DOUBLE * (CASE WHEN p_size % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_type <> 'PROMO' THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 0 THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(p_name, '')) <> '' THEN 1 ELSE 0 END) / 4, 1) AS completeness,
CASE WHEN p_size >= 40 THEN 30 WHEN p_size >= 25 THEN 45 WHEN p_size > 10 THEN 60 ELSE 0 END AS minutes FROM part""")
def completeness_score(spark, d):
    """Share of filled fields (zero counts as missing) and a step function."""
    flags = [F.col("p_size") % 7 != 0, F.col("p_type") != "PROMO", F.col("p_retailprice") > 0, F.trim(F.coalesce("p_name", F.lit(""))) != ""]
    filled = sum((F.when(f, 1).otherwise(0) for f in flags[1:]), F.when(flags[0], 1).otherwise(0))
    size = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", F.round(F.lit(100.0) * filled / 4, 1).alias("completeness"), F.when(size >= 40, 30).when(size >= 25, 45).when(size > 10, 60).otherwise(0).alias("minutes"))


@query("budget_analysis", """SELECT c_custkey, CAST(trunc(v * 0.3::DOUBLE) AS INT) AS down, CAST(trunc((v - v * 0.3::DOUBLE) / 36) AS INT) AS monthly, CAST(trunc(v * CASE WHEN c_nationkey % 2 = 0 THEN 0.72::DOUBLE ELSE 0.85::DOUBLE END) AS INT) AS reach
FROM (SELECT *, coalesce(nullif(greatest(c_acctbal, 0.0), 0.0), 300.0)::DOUBLE AS v FROM customer)""")
def budget_analysis(spark, d):
    """Down payment, instalment and seasonal reach, truncated; zero or negative budgets take the default."""
    v = F.coalesce(F.nullif(F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0)), F.lit(300.0))
    return t(spark, d, "customer").select("c_custkey", (v * 0.3).cast("int").alias("down"), ((v - v * 0.3) / 36).cast("int").alias("monthly"), (v * F.when(F.col("c_nationkey") % 2 == 0, 0.72).otherwise(0.85)).cast("int").alias("reach"))


@query("lead_budget_buckets", """SELECT CASE WHEN o_totalprice <= 150000 THEN 'a<=15' WHEN o_totalprice <= 250000 THEN 'b<=25' WHEN o_totalprice <= 350000 THEN 'c<=35' ELSE 'd>35' END AS bucket, c_mktsegment, count(*) AS n, CAST(floor(avg(o_totalprice)) AS BIGINT) AS mean_budget
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def lead_budget_buckets(spark, d):
    price = F.col("o_totalprice")
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.when(price <= 150000, "a<=15").when(price <= 250000, "b<=25").when(price <= 350000, "c<=35").otherwise("d>35").alias("bucket"), "c_mktsegment").agg(F.count("*").alias("n"), F.floor(F.avg(price)).alias("mean_budget"))


@query("concern_explode", """SELECT concern, count(*) AS n FROM (SELECT unnest(string_split(lower(replace(o_orderpriority, '-', ',')) || ',' || lower(o_orderstatus), ',')) AS concern FROM orders) GROUP BY concern""")
def concern_explode(spark, d):
    return t(spark, d, "orders").select(F.explode(F.split(F.concat(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(","))), F.lit(","), F.lower("o_orderstatus")), ",")).alias("concern")).groupBy("concern").agg(F.count("*").alias("n"))


@query("claim_unpivot", """SELECT p_partkey, attribute, value FROM (SELECT p_partkey, rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') || ' wan' AS price, CAST(p_size AS VARCHAR) || ' cm' AS size, p_type AS type FROM part) UNPIVOT (value FOR attribute IN (price, size, type))""")
def claim_unpivot(spark, d):
    """Catalog cells as (entity, attribute, value with unit) claims."""
    price = F.concat(F.regexp_replace(F.regexp_replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), "0+$", ""), "\\.$", ""), F.lit(" wan"))
    wide = t(spark, d, "part").select("p_partkey", price.alias("price"), F.concat(F.col("p_size").cast("string"), F.lit(" cm")).alias("size"), F.col("p_type").alias("type"))
    return wide.unpivot(["p_partkey"], ["price", "size", "type"], "attribute", "value")


@query("template_product", """SELECT row_number() OVER (ORDER BY a.n_nationkey, r.r_regionkey, o.i) AS idx, a.n_name || ' vs ' || r.r_name || ' for ' || o.use AS prompt FROM nation a, region r, (VALUES (0, 'city'), (1, 'family'), (2, 'trips')) o(i, use) QUALIFY idx <= 120""")
def template_product(spark, d):
    """Product of small dimensions in a fixed order, first 120."""
    use = spark.createDataFrame([(0, "city"), (1, "family"), (2, "trips")], "i int, use string")
    everything = t(spark, d, "nation").crossJoin(F.broadcast(t(spark, d, "region"))).crossJoin(F.broadcast(use)).orderBy("n_nationkey", "r_regionkey", "i").limit(120)
    return everything.select(F.row_number().over(W.orderBy("n_nationkey", "r_regionkey", "i")).cast("long").alias("idx"), F.concat("n_name", F.lit(" vs "), "r_name", F.lit(" for "), "use").alias("prompt"))


@query("pair_combinations", """SELECT a.n_nationkey AS a, b.n_nationkey AS b, (row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey) - 1) % 8 AS context FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""")
def pair_combinations(spark, d):
    n = t(spark, d, "nation").select("n_nationkey")
    pairs = n.alias("x").join(F.broadcast(n.alias("y")), F.col("x.n_nationkey") < F.col("y.n_nationkey")).select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"))
    return pairs.select("a", "b", ((F.row_number().over(W.orderBy("a", "b")) - 1) % 8).cast("long").alias("context"))


@query("gated_argmax", """SELECT p_brand, round(avg(p_retailprice), 4) AS recommend, round(avg(p_size), 4) AS sales FROM part GROUP BY p_brand HAVING avg(p_retailprice) >= 948 AND avg(p_size) > 20 ORDER BY round(avg(p_size), 4) DESC, p_brand LIMIT 1""")
def gated_argmax(spark, d):
    g = t(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("r"), F.avg("p_size").alias("s")).where("r >= 948 and s > 20")
    return g.select("p_brand", F.round("r", 4).alias("recommend"), F.round("s", 4).alias("sales")).orderBy(F.desc("sales"), "p_brand").limit(1)


@query("nearest_to_target", """SELECT lang, arg_min(doc_id, abs(n_chars - 1500) * 1000000000 + doc_id) AS doc_id FROM documents GROUP BY lang""")
def nearest_to_target(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", F.struct(F.abs(F.col("n_chars") - 1500), "doc_id")).alias("doc_id"))
