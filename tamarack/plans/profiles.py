"""Profiles, routes, scenes, pools and vehicle names of questions written by rule, one for each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.operators import profile as P
from tamarack.plans.registry import query
from tamarack.session import table as t

#: Phrases of the questions; phrase i of a list goes to customers whose key has the remainder i.
PHRASES = [
    ["预算20万", "预算 15.5 w", "不限预算", "大概30W以内"],
    ["通勤单程30公里", "通勤大概 12.5 km", "很少开车"],
    ["三口之家", "5口人的大家庭", "二胎", "一个人", ""],
    ["没有家充", "有充电桩", "没有固定车位", "坐标成都市", "家充已装", "混动也行", "想要增程，在上海"],
    ["想要SUV", "看看mpv", "要轿车", "约会有面子", "对比小鹏 G6和问界  M7", "海外参数", "怎么选", "喜欢比亚迪", "Model Y L试驾，model y l", "续航和安全", "理想 L7 智驾，客户买豪车"],
]
CITIES = ("上海", "北京")


def _list_sql(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any_sql(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _first_sql(c, words_of, otherwise="NULL"):
    return "CASE " + " ".join(f"WHEN {_any_sql(c, words)} THEN '{label}'" for label, words in words_of.items()) + f" ELSE {otherwise} END"


def _hits_sql(c, words_of):
    return "list_filter([" + ", ".join(f"CASE WHEN {_any_sql(c, words)} THEN '{label}' END" for label, words in words_of.items()) + "], lambda x: x IS NOT NULL)"


def _number_sql(c, pattern):
    return f"nullif(TRY_CAST(regexp_extract({c}, '{pattern}', 1) AS DOUBLE), 0)"


ASK_SQL = "a AS (SELECT c_custkey, concat_ws('，', " + ", ".join(f"{_list_sql(words)}[1 + c_custkey % {len(words)}]" for words in PHRASES) + ") AS ask FROM customer)"
PROFILE_SQL = f"""{ASK_SQL}, p AS (SELECT *, CAST({_number_sql('ask', P.BUDGET)} * 10000 AS INT) AS budget_max, {_number_sql('ask', P.COMMUTE)} AS commute_km,
coalesce(CAST({_number_sql('ask', P.HOUSEHOLD)} AS INT), CASE WHEN contains(ask, '三口') THEN 3 WHEN contains(ask, '二胎') THEN 4 END) AS family_size,
coalesce({', '.join(f"CASE WHEN contains(ask, '{c}') THEN '{c}' END" for c in CITIES)}, nullif(regexp_extract(ask, '{P.CITY}', 1), '')) AS city,
CASE WHEN {_any_sql('ask', P.NO_CHARGER)} THEN FALSE WHEN {_any_sql('ask', P.CHARGER)} THEN TRUE END AS has_home_charger,
{_first_sql('lower(ask)', {x: [x.lower()] for x in P.TYPES}, f"CASE WHEN contains(ask, '{P.LUXURY}') THEN '{P.LUXURY}' END")} AS preferred_type,
{_first_sql('ask', P.ENERGIES)} AS preferred_energy,
list_concat(CASE WHEN {_any_sql('ask', P.SOCIAL)} THEN {_list_sql(P.SOCIAL_CONCERNS)} ELSE [] END, {_hits_sql('ask', P.CONCERNS)}) AS concerns,
{_hits_sql('ask', {b: [b] for b in P.BRANDS})} AS preferred_brands, {_first_sql('ask', P.INTENT_LEVELS)} AS intent_level FROM a)"""
_KNOWN_SQL = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in ("budget_max", "city", "family_size", "commute_km", "has_home_charger"))


def questions(spark, d):
    key = F.col("c_custkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", F.concat_ws("，", *map(pick, PHRASES)).alias("ask"))


@query("profile_extract", f"""WITH {PROFILE_SQL} SELECT c_custkey, budget_max, commute_km, family_size, city, has_home_charger, preferred_type, preferred_energy, array_to_string(concerns, '|') AS concerns, array_to_string(preferred_brands, '|') AS preferred_brands, intent_level,
CAST(round(({_KNOWN_SQL} + CAST(len(concerns) > 0 AS INT)) / 6 * 100) AS INT) AS confidence FROM p""")
def profile_extract(spark, d):
    """Fields of a question and the share of important ones that it gives."""
    p = P.with_profile(questions(spark, d), cities=CITIES).withColumn("confidence", P.confidence())
    return p.withColumn("concerns", F.array_join("concerns", "|")).withColumn("preferred_brands", F.array_join("preferred_brands", "|")).drop("ask")


_SCENE_SQL = "lower(concat_ws(' ', ask, coalesce(preferred_type, ''), array_to_string(concerns, ' ')))"
_MISSING_SQL = " + ".join(f"CAST({c} IS NULL AS INT)" for c in ("budget_max", "family_size", "commute_km", "has_home_charger"))
_HINT_SQL = {name: _any_sql("lower(ask)", [w.lower() for w in words]) for name, words in (("real", P.REAL_HINTS), ("complex", P.COMPLEX_HINTS), ("local", P.LOCAL_HINTS))}


@query("question_routing", f"""WITH {PROFILE_SQL}, q AS (SELECT *, CASE c_custkey % 13 WHEN 0 THEN ' Local ' WHEN 1 THEN 'other' ELSE NULL END AS strategy FROM p)
SELECT c_custkey, {_first_sql('ask', P.ROUTES, "'knowledge'")} AS intent, {_first_sql(_SCENE_SQL, P.SCENES, "'general'")} AS scene,
CASE WHEN lower(trim(strategy)) IN ('local', 'real', 'fused') THEN lower(trim(strategy)) WHEN {_HINT_SQL['real']} THEN 'real' WHEN coalesce(preferred_type, '') = 'MPV' OR coalesce(family_size, 0) >= 5 THEN 'local' WHEN {_MISSING_SQL} >= 2 OR {_HINT_SQL['complex']} THEN 'fused' WHEN {_HINT_SQL['local']} THEN 'local' ELSE 'fused' END AS pool FROM q""")
def question_routing(spark, d):
    """Intent, scene and candidate pool of a question."""
    strategy = F.when(F.col("c_custkey") % 13 == 0, " Local ").when(F.col("c_custkey") % 13 == 1, "other")
    p = P.with_profile(questions(spark, d), cities=CITIES)
    return p.select("c_custkey", P.route(F.col("ask")).alias("intent"), P.scene(F.col("ask")).alias("scene"), P.pool(F.col("ask"), strategy).alias("pool"))


_FOUND_SQL = "list_concat(" * (len(P.VEHICLES) - 1) + ", ".join(f"regexp_extract_all(ask, '(?i)({p})', 1)" + (")" if i else "") for i, p in enumerate(P.VEHICLES))


@query("vehicle_mentions", f"""WITH {ASK_SQL}, f AS (SELECT c_custkey, list_transform({_FOUND_SQL}, lambda x: trim(regexp_replace(x, '{P.SPACE}+', ' ', 'g'))) AS xs FROM a), l AS (SELECT *, list_transform(xs, lambda x: lower(x)) AS ls FROM f)
SELECT c_custkey, array_to_string(list_filter(xs, lambda x, i: list_position(ls, lower(x)) = i)[1:{P.MAX_VEHICLES}], '|') AS vehicles FROM l""")
def vehicle_mentions(spark, d):
    return questions(spark, d).select("c_custkey", F.array_join(P.vehicle_mentions(F.col("ask")), "|").alias("vehicles"))


#: Titles, and keys of the catalog that are not news.
TITLES = ["BMW i4 对比 宝马 3系", "tesla Model Y 和特斯拉 Model 3", "保时捷Taycan，Polestar 4", "MG 4 与名爵 Cyberster，mg 4", "蔚来 ET5、小米 SU7、极氪 001、bmw I4、问界M9、腾势 Z9", "no title"]
KNOWN = ["小米su7", "bmwi4x"]
_PAIR_SQL = [f"list_transform(list_zip(regexp_extract_all(x, '(?i){p}', 1), regexp_extract_all(x, '(?i){p}', 2)), lambda y: y[1] || ' ' || replace(y[2], ' ', ''))" for p in P.TITLE_MODELS]


@query("title_models", f"""WITH a AS (SELECT c_custkey, {_list_sql(TITLES)}[1 + c_custkey % {len(TITLES)}] AS x FROM customer), f AS (SELECT c_custkey, list_filter(flatten([{', '.join(_PAIR_SQL)}]), lambda y: NOT list_contains({_list_sql(KNOWN)}, lower(replace(y, ' ', '')))) AS xs FROM a), l AS (SELECT *, list_transform(xs, lambda y: lower(replace(y, ' ', ''))) AS ks FROM f)
SELECT c_custkey, array_to_string(list_filter(xs, lambda y, i: list_position(ks, lower(replace(y, ' ', ''))) = i)[1:{P.MAX_TITLE_MODELS}], '|') AS models FROM l""")
def title_models(spark, d):
    """Names that titles bring beyond the catalog."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("c_custkey") % len(TITLES) + 1).cast("int"))
    found = t(spark, d, "customer").select("c_custkey", P.title_models(title, F.array(*map(F.lit, KNOWN))).alias("m"))
    return found.select("c_custkey", F.array_join(F.transform("m", lambda x: F.concat_ws(" ", x["brand"], x["model"])), "|").alias("models"))
