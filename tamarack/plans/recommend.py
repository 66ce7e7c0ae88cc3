"""Full recommendations, recall, comparison and pools for a fixed set of profiles over a catalog made from ``part``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators import recommend as R
from tamarack.plans.registry import query
from tamarack.session import table as t

BRANDS = ["奔驰", "宝马", "特斯拉", "小米", "问界", "比亚迪", "蔚来", "小鹏"]
TYPES, ENERGIES = ["SUV", "轿车", "MPV", "旅行车"], ["纯电", "增程", "燃油", "插混"]
SCENARIOS, HIGHLIGHTS = ["家庭;通勤", "商务;豪华", "长途;续航", "城市"], ["智驾;空间", "低使用成本;省油", "社交形象", "续航", "能耗低"]
CONCERNS = [[], ["智驾", "空间"], ["社交形象"], ["续航", "价格"], ["社交形象", "续航", "智驾"]]


def pick(values, index):
    """The value of a list that a remainder points at."""
    lit = lambda v: F.lit(None) if v is None else F.array(*(F.lit(x) for x in v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.element_at(F.array(*(lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def pick_sql(values, index):
    lit = lambda v: "NULL" if v is None else "CAST([" + ", ".join(f"'{x}'" for x in v) + "] AS VARCHAR[])" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return "[" + ", ".join(lit(v) for v in values) + f"][CAST(({index}) % {len(values)} + 1 AS INT)]"


def cars(spark, d):
    """Parts seen as catalog rows with the full set of fields."""
    k = F.col("p_partkey")
    whole = lambda x: F.floor(x)
    return t(spark, d, "part").select(
        k.alias("id"), pick(BRANDS, k).alias("brand"), F.concat(F.lit("M"), k.cast("string")).alias("model"), pick(TYPES, whole(k / 8)).alias("vehicle_type"), pick(ENERGIES, whole(k / 3)).alias("energy_type"),
        ((k % 50 + 8) * 10000).alias("price_min"), ((k % 50 + 8) * 10000 + k % 7 * 10000).alias("price_max"), (k % 13 * 60).alias("cltc_range"), (k % 4 + 4).alias("seats"), (F.col("p_size") * 10 + 2600).alias("wheelbase"),
        F.when(k % 3 == 0, "L2+").otherwise("L2").alias("adas_level"), F.when(k % 10 == 0, 4.6).otherwise((k % 25 + 80).cast("double")).alias("safety_score"), (k % 997).alias("monthly_sales"),
        pick(SCENARIOS, k).alias("suitable_scenarios"), pick(HIGHLIGHTS, whole(k / 2)).alias("highlights"), F.when(k % 6 == 0, "").otherwise("后排偏小").alias("weaknesses"), pick(["local", "real"], whole(k / 5)).alias("pool"),
    )


CARS_SQL = f"""car AS (SELECT p_partkey AS id, {pick_sql(BRANDS, 'p_partkey')} AS brand, 'M' || p_partkey AS model, {pick_sql(TYPES, 'p_partkey // 8')} AS vehicle_type, {pick_sql(ENERGIES, 'p_partkey // 3')} AS energy_type,
  (p_partkey % 50 + 8) * 10000 AS price_min, (p_partkey % 50 + 8) * 10000 + p_partkey % 7 * 10000 AS price_max, p_partkey % 13 * 60 AS cltc_range, p_partkey % 4 + 4 AS seats, p_size * 10 + 2600 AS wheelbase,
  CASE WHEN p_partkey % 3 = 0 THEN 'L2+' ELSE 'L2' END AS adas_level, CASE WHEN p_partkey % 10 = 0 THEN 4.6::DOUBLE ELSE CAST(p_partkey % 25 + 80 AS DOUBLE) END AS safety_score, p_partkey % 997 AS monthly_sales,
  {pick_sql(SCENARIOS, 'p_partkey')} AS suitable_scenarios, {pick_sql(HIGHLIGHTS, 'p_partkey // 2')} AS highlights, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '后排偏小' END AS weaknesses, {pick_sql(['local', 'real'], 'p_partkey // 5')} AS pool FROM part)"""

#: Fields of the profiles: value i of a list goes to profiles with that remainder.
ASKED = {
    "budget_max": [None, 150000, 300000, 0, 450000], "budget_min": [None, 100000, 0], "family_size": [None, 0, 3, 5], "commute_km": [None, 30, 90], "has_home_charger": [True, False, None],
    "preferred_type": [None, "SUV", "", "MPV"], "preferred_energy": ["", "纯电", None, "插混", "增程"], "preferred_brands": [[], ["问界", "小米"], ["宝马"]], "concerns": CONCERNS, "mentioned_models": [[], [], [], ["宝马 M1", "小鹏 M7"]],
}
PROFILES = 60


def asks(spark, d):
    """The different profiles of all customers: customers of one remainder ask alike."""
    k = F.col("profile")
    return t(spark, d, "customer").select((F.col("c_custkey") % PROFILES).alias("profile")).distinct().select(k, *(pick(v, F.floor(k / (i % 3 + 1))).alias(n) for i, (n, v) in enumerate(ASKED.items())))


ASKS_SQL = f"ask AS (SELECT profile, {', '.join(f'{pick_sql(v, f"profile // {i % 3 + 1}")} AS {n}' for i, (n, v) in enumerate(ASKED.items()))} FROM (SELECT DISTINCT c_custkey % {PROFILES} AS profile FROM customer))"


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: The rules of the score as SQL, from the written description: defaults, sub-scores, bonuses, texts.
SCORED_SQL = f"""d AS (SELECT *, coalesce(nullif(budget_max, 0), 300000) AS b, coalesce(nullif(budget_min, 0), 0) AS b0, coalesce(nullif(commute_km, 0), 40) AS km, coalesce(nullif(family_size, 0), 3) AS fam, (price_min + price_max) / 2.0::DOUBLE AS mid,
  list_contains(mentioned_models, brand || ' ' || model) AS named, coalesce(preferred_type, '') <> '' AS typed, coalesce(preferred_type, '') <> '' AND contains(vehicle_type, coalesce(preferred_type, '')) AS fits FROM car CROSS JOIN ask),
u AS (SELECT *,
  CASE WHEN named THEN 88.0::DOUBLE WHEN price_min <= b AND price_max >= b0 THEN 100 - greatest((mid - b) / greatest(b, 1) * 40, 0.0::DOUBLE) ELSE greatest(30.0::DOUBLE, 100 - abs((mid - b) / greatest(b, 1)) * 100) END AS s1,
  CASE WHEN energy_type = '燃油' THEN 86.0::DOUBLE ELSE least(cltc_range / CAST(greatest(km * 7, 350) AS DOUBLE) * 100, 100.0::DOUBLE) END AS s2,
  CAST(least(greatest(75 + CASE WHEN fam >= 4 THEN CASE WHEN seats >= 5 AND wheelbase >= 2900 THEN 10 ELSE -5 END ELSE 0 END + CASE WHEN vehicle_type IN ('SUV', 'MPV') THEN 10 ELSE 0 END, 40), 100) AS DOUBLE) AS s3,
  CASE WHEN energy_type = '燃油' OR has_home_charger IS NULL THEN 82.0::DOUBLE WHEN has_home_charger THEN CASE WHEN energy_type = '纯电' THEN 92.0::DOUBLE ELSE 84.0::DOUBLE END WHEN energy_type IN ('插混', '增程') THEN 94.0::DOUBLE ELSE 72.0::DOUBLE END AS s4,
  CASE WHEN contains(adas_level, '+') THEN 92.0::DOUBLE ELSE 78.0::DOUBLE END + CASE WHEN list_contains(concerns, '智驾') THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS s5,
  least(safety_score, 100.0::DOUBLE) AS s6,
  CAST(least(75 + 5 * len(list_filter(concerns, lambda c: contains(suitable_scenarios || ';' || highlights || ';' || brand || ';' || model, c))) + CASE WHEN fits THEN 8 ELSE 0 END + CASE WHEN coalesce(preferred_energy, '') <> '' AND preferred_energy = energy_type THEN 8 ELSE 0 END
    + CASE WHEN list_contains(preferred_brands, brand) THEN 8 ELSE 0 END + CASE WHEN named THEN 24 ELSE 0 END, 100) AS DOUBLE) AS s7,
  CASE WHEN NOT typed THEN 0 WHEN fits THEN 10 ELSE -10 END
    + CASE WHEN list_contains(concerns, '社交形象') THEN CASE WHEN brand IN {_in(R.LUXURY)} THEN 22 WHEN {_any("brand || ';' || suitable_scenarios || ';' || highlights", R.LUXURY_WORDS)} THEN 12 ELSE 0 END ELSE 0 END
    + CASE WHEN fam >= 4 AND vehicle_type = 'MPV' THEN 10 ELSE 0 END AS extra FROM d),
s AS (SELECT *, round(round(least(greatest(s1 * 0.25::DOUBLE + s2 * 0.2::DOUBLE + s3 * 0.15::DOUBLE + s4 * 0.15::DOUBLE + s5 * 0.1::DOUBLE + s6 * 0.1::DOUBLE + s7 * 0.05::DOUBLE + extra, 0.0::DOUBLE), 100.0::DOUBLE), 6), 1) AS score FROM u),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile ORDER BY named DESC, score DESC, monthly_sales DESC, id) AS INT) AS rank FROM s)"""
PARTS_SQL = ", ".join(f"round(round({'least(s5, 100.0::DOUBLE)' if i == 4 else f's{i + 1}'}, 6), 1) AS {n}_score" for i, n in enumerate(R.NAMES))


@query("recommend_scores", f"WITH {CARS_SQL}, {ASKS_SQL}, {SCORED_SQL} SELECT profile, rank, id, score, named AS is_mentioned, {PARTS_SQL} FROM best WHERE rank <= 5")
def recommend_scores(spark, d):
    """Five best rows of every profile with all sub-scores; mentioned models stand first."""
    return R.recommend(asks(spark, d), cars(spark, d), "profile", "id").select("profile", "rank", "id", "score", "is_mentioned", *(f"{n}_score" for n in R.NAMES))


REASONS_SQL = f"""array_to_string(list_filter([CASE WHEN named THEN '{R.REASONS["mentioned"]}' END, '预算匹配度 ' || CAST(round(round(s1, 6)) AS BIGINT) || ' 分', '续航匹配度 ' || CAST(round(round(s2, 6)) AS BIGINT) || ' 分', '空间匹配度 ' || CAST(round(round(s3, 6)) AS BIGINT) || ' 分',
  CASE WHEN NOT has_home_charger AND energy_type IN ('插混', '增程') THEN '{R.REASONS["no_charger"]}' END, CASE WHEN list_contains(concerns, '智驾') AND contains(adas_level, '+') THEN '{R.REASONS["smart"]}' END, CASE WHEN list_contains(concerns, '空间') AND vehicle_type = 'SUV' THEN '{R.REASONS["space"]}' END,
  CASE WHEN list_contains(concerns, '社交形象') THEN CASE WHEN brand IN {_in(R.KNOWN_LUXURY)} THEN '{R.REASONS["luxury"]}' WHEN brand IN {_in(R.TECHNICAL)} THEN '{R.REASONS["technical"]}' END END], lambda x: x IS NOT NULL), '|')"""
CAUTIONS_SQL = f"""array_to_string(list_filter([CASE WHEN price_min > b THEN '{R.CAUTIONS["price"]}' END, CASE WHEN energy_type = '纯电' AND NOT has_home_charger THEN '{R.CAUTIONS["charging"]}' END, CASE WHEN cltc_range < 550 AND list_contains(concerns, '续航') THEN '{R.CAUTIONS["range"]}' END, nullif(weaknesses, '')], lambda x: x IS NOT NULL)[1:3], '|')"""


@query("recommend_texts", f"WITH {CARS_SQL}, {ASKS_SQL}, {SCORED_SQL} SELECT profile, rank, id, {REASONS_SQL} AS reasons, {CAUTIONS_SQL} AS cautions FROM best WHERE rank <= 3")
def recommend_texts(spark, d):
    """Reasons in their order and at most three cautions of the three best rows."""
    return R.recommend(asks(spark, d), cars(spark, d), "profile", "id", 3).select("profile", "rank", "id", F.array_join("reasons", "|").alias("reasons"), F.array_join("cautions", "|").alias("cautions"))


@query("recall_mentioned", f"""WITH {CARS_SQL}, {ASKS_SQL}, p AS (SELECT profile, id, price_min, len(mentioned_models) > 0 AS names, list_contains(mentioned_models, brand || ' ' || model) AS named,
  (coalesce(budget_max, 0) = 0 OR price_min <= budget_max * 1.25::DOUBLE) AND (coalesce(preferred_type, '') = '' OR contains(vehicle_type, preferred_type)) AND (coalesce(preferred_energy, '') = '' OR preferred_energy = energy_type) AS fits FROM car CROSS JOIN ask),
k AS (SELECT *, CASE WHEN names THEN named ELSE fits END AS keep FROM p), a AS (SELECT *, max(CAST(keep AS INT)) OVER (PARTITION BY profile) AS any_kept FROM k)
SELECT profile, count(*) AS n, min(id) AS least, max(price_min) AS dearest FROM a WHERE keep OR (NOT names AND any_kept = 0) GROUP BY profile""")
def recall_mentioned(spark, d):
    """Candidates of every profile: mentioned models, else filters, else everything."""
    found = R.recalled(cars(spark, d).crossJoin(F.broadcast(asks(spark, d))), "profile")
    return found.groupBy("profile").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("price_min").alias("dearest"))


NAMED = [(1, "m12"), (2, "小米 M3"), (3, "请比较 m7 和别的"), (4, "没有这款"), (5, "奔驰 M16")]
NAMED_SQL = f"{CARS_SQL}, n(place, asked) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in NAMED)}), h AS (SELECT * FROM car JOIN n ON contains(lower(brand || ' ' || model), lower(asked)) OR contains(lower(asked), lower(model)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1)"
ONE_ASK_SQL = "ask AS (SELECT NULL::INT AS budget_max, NULL::INT AS budget_min, 5 AS family_size, 90 AS commute_km, FALSE AS has_home_charger, 'MPV' AS preferred_type, '纯电' AS preferred_energy, ['问界'] AS preferred_brands, ['社交形象', '续航'] AS concerns, CAST([] AS VARCHAR[]) AS mentioned_models, 0 AS profile)"


def one_ask(spark):
    schema = "profile int, budget_max int, budget_min int, family_size int, commute_km int, has_home_charger boolean, preferred_type string, preferred_energy string, preferred_brands array<string>, concerns array<string>, mentioned_models array<string>"
    return spark.createDataFrame([(0, None, None, 5, 90, False, "MPV", "纯电", ["问界"], ["社交形象", "续航"], [])], schema)


@query("compare_named", f"WITH {NAMED_SQL}, {ONE_ASK_SQL}, {SCORED_SQL.replace('FROM car CROSS JOIN ask', 'FROM h CROSS JOIN ask')} SELECT place, id, score, {PARTS_SQL} FROM s")
def compare_named(spark, d):
    """Scores of all rows that a list of names finds, either way round."""
    rows = R.named_rows(spark.createDataFrame(NAMED, "place int, asked string"), cars(spark, d), "id")
    return R.scored(rows.crossJoin(F.broadcast(one_ask(spark)))).select("place", "id", "score", *(f"{n}_score" for n in R.NAMES))


EXACT = [(1, "宝马 M9"), (2, "没有这款"), (3, "小鹏 M15"), (4, "宝马 M9")]


@query("named_with_supplement", f"""WITH {CARS_SQL}, {ONE_ASK_SQL}, {SCORED_SQL}, n(place, asked) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in EXACT)}),
r AS (SELECT place, asked, id, score FROM n LEFT JOIN s ON asked = brand || ' ' || model), f AS (SELECT *, CASE WHEN id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY place) > 1 THEN 'missing' ELSE 'named' END AS part FROM r),
x AS (SELECT id, score, row_number() OVER (ORDER BY rank) AS nth FROM best WHERE id NOT IN (SELECT id FROM f WHERE part = 'named'))
SELECT part, CAST(place AS INT) AS place, asked, CASE WHEN part = 'named' THEN id END AS id, CASE WHEN part = 'named' THEN score END AS score FROM f
UNION ALL SELECT 'supplement', CAST(nth AS INT), NULL, id, score FROM x WHERE nth <= 6 - (SELECT count(*) FROM f WHERE part = 'named')""")
def named_with_supplement(spark, d, k: int = 6):
    """Resolved names, missing or repeated ones, and the best other rows up to ``k`` together."""
    names = spark.createDataFrame(EXACT, "place int, asked string")
    every = R.scored(cars(spark, d).crossJoin(F.broadcast(one_ask(spark)))).withColumn("full", R.full_name())
    hits = names.join(every.select("full", "id", "score"), F.col("asked") == F.col("full"), "left")
    again = F.row_number().over(W.partitionBy("id").orderBy("place")) > 1
    found = hits.withColumn("part", F.when(F.col("id").isNull() | again, "missing").otherwise("named"))
    named = found.where("part = 'named'")
    order = [F.desc("is_mentioned"), F.desc("score"), F.desc("monthly_sales"), F.col("id")]
    best = every.orderBy(*order).limit(k + len(EXACT)).join(named.select(F.col("id").alias("taken")), F.col("id") == F.col("taken"), "left_anti")
    nth = best.withColumn("place", F.row_number().over(W.orderBy(*order))).crossJoin(named.agg(F.count("*").alias("have"))).where(F.col("place") <= k - F.col("have"))
    only = lambda c: F.when(F.col("part") == "named", F.col(c)).alias(c)
    return found.select("part", "place", "asked", only("id"), only("score")).unionByName(nth.select(F.lit("supplement").alias("part"), "place", F.lit(None).cast("string").alias("asked"), "id", "score"))


@query("heuristic_rank", f"""WITH {CARS_SQL}, n(ask, budget, kind, energy, concerns) AS (VALUES (1, 200000, 'SUV', '插混', ['空间', '续航']), (2, 300000, NULL, NULL, ['智驾']), (3, 120000, '轿车', '纯电', ['低使用成本', 'L2+'])),
r AS (SELECT ask, id, round(100 - least(abs((price_min + price_max) / 2.0::DOUBLE - budget) / greatest(budget, 1) * 20, 30.0::DOUBLE) + CASE WHEN kind IS NOT NULL AND contains(vehicle_type, kind) THEN 10 ELSE 0 END
  + CASE WHEN energy IS NULL THEN 0 WHEN energy_type = energy THEN 12 WHEN energy = '插混' AND energy_type = '增程' THEN 4 ELSE -10 END + 2 * len(list_filter(concerns, lambda c: contains(highlights || ' ' || suitable_scenarios || ' ' || adas_level, c))), 4) AS score FROM car CROSS JOIN n)
SELECT ask, id, score, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS INT) AS rank FROM r QUALIFY rank <= 8""")
def heuristic_rank(spark, d):
    """Eight best rows of three parsed questions by the catalog heuristic."""
    n = spark.createDataFrame([(1, 200000, "SUV", "插混", ["空间", "续航"]), (2, 300000, None, None, ["智驾"]), (3, 120000, "轿车", "纯电", ["低使用成本", "L2+"])], "ask int, budget int, kind string, energy string, concerns array<string>")
    score = R.heuristic_score(F.col("budget"), F.col("kind"), F.col("energy"), F.col("concerns"))
    r = cars(spark, d).crossJoin(F.broadcast(n)).select("ask", "id", F.round(score, 4).alias("score"))
    return r.withColumn("rank", F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "id"))).where("rank <= 8")


@query("pool_dispatch", f"""WITH {CARS_SQL}, {ONE_ASK_SQL}, {SCORED_SQL}, c AS (SELECT id, pool, score, score - CASE WHEN pool = 'real' THEN 2 + CASE WHEN id % 4 = 0 THEN 5 ELSE 0 END ELSE 0 END AS fused, score - CASE WHEN id % 4 = 0 THEN 6 ELSE 0 END AS real FROM s),
a AS (SELECT 'local' AS strategy, id, score FROM c WHERE pool = 'local' UNION ALL SELECT 'real', id, real FROM c WHERE pool = 'real' UNION ALL SELECT 'fused', id, fused FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY strategy ORDER BY score DESC, id) AS INT) AS rank FROM a) SELECT strategy, rank, id, round(score, 1) AS score FROM r WHERE rank <= 5""")
def pool_dispatch(spark, d):
    """The ranking of each pool: local as it is, real less 6 for weak records, fused less 2 for real ones and 5 more for weak ones."""
    c = R.scored(cars(spark, d).crossJoin(F.broadcast(one_ask(spark)))).select("id", "pool", "score")
    weak, real = F.col("id") % 4 == 0, F.col("pool") == "real"
    less = lambda when, n: F.when(when, n).otherwise(0)
    ways = F.array(*(F.struct(F.lit(name).alias("strategy"), keep.alias("keep"), value.alias("score")) for name, keep, value in (("local", ~real, F.col("score")), ("real", real, F.col("score") - less(weak, 6)), ("fused", F.lit(True), F.col("score") - less(real, 2 + less(weak, 5))))))
    a = c.select("id", F.explode(ways).alias("w")).select("id", "w.*").where("keep")
    r = a.withColumn("rank", F.row_number().over(W.partitionBy("strategy").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    return r.select("strategy", "rank", "id", F.round("score", 1).alias("score"))


@query("popularity_scan", f"WITH {CARS_SQL} SELECT id, brand, model, monthly_sales, CAST(row_number() OVER (ORDER BY monthly_sales DESC, id) AS INT) AS place FROM car QUALIFY place <= 500")
def popularity_scan(spark, d):
    """A page of the catalog by popularity, with a unique tie-break."""
    order = [F.desc("monthly_sales"), F.col("id")]
    page = cars(spark, d).select("id", "brand", "model", "monthly_sales").orderBy(*order).limit(500)
    return page.withColumn("place", F.row_number().over(W.orderBy(*order)))


@query("demo_seeding", f"""WITH {CARS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY monthly_sales DESC, id) - 1 AS ord, count(*) OVER () AS n FROM car), s AS (SELECT range AS i FROM range(12)), f AS (SELECT range AS place FROM range(3))
SELECT CAST(i AS INT) AS scenario, CAST(place AS INT) AS place, id, 92 - 5 * CAST(place AS INT) AS score, greatest(88 - 5 * CAST(place AS INT), 0) AS budget_score, strftime(TIMESTAMP '2024-03-01' - to_days(CAST(i AS INT)), '%Y-%m-%d') AS created FROM s CROSS JOIN f JOIN o ON ord = (i * 3 + place) % n""")
def demo_seeding(spark, d):
    """Twelve demo scenarios: three rows each, picked by position, with scores by place and falling dates."""
    by = W.orderBy(F.desc("monthly_sales"), "id")
    total = F.broadcast(t(spark, d, "part").agg(F.count("*").alias("n")))
    wanted = spark.range(12).select(F.col("id").cast("int").alias("scenario"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place")).crossJoin(total).withColumn("at", (F.col("scenario") * 3 + F.col("place")) % F.col("n"))
    # at most 36 positions are asked for, all of them among the first 36 places of the order or its start
    first = cars(spark, d).select("id", "monthly_sales").orderBy(F.desc("monthly_sales"), "id").limit(36).withColumn("ord", F.row_number().over(by).cast("long") - 1)
    rows = wanted.join(first, F.col("at") == F.col("ord"))
    return rows.select("scenario", "place", "id", (92 - 5 * F.col("place")).alias("score"), F.greatest(88 - 5 * F.col("place"), F.lit(0)).alias("budget_score"), F.date_format(F.date_sub(F.lit("2024-03-01").cast("date"), F.col("scenario")), "yyyy-MM-dd").alias("created"))
