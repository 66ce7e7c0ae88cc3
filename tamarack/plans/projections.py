"""Field derivations, cards and labels of catalog rows; text rules on titles, questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text as X
from tamarack.plans.recommend import CARS_SQL, cars
from tamarack.plans.registry import query
from tamarack.session import table as t

#: Catalog types of a public source, and the one for everything else.
TYPES, OTHER_TYPE = {"passenger_car": "轿车", "suv": "SUV", "van": "MPV", "truck": "皮卡", "micro": "微型车"}, "轿车"
#: Brands of the imputation rules.
LUXURY = ("Audi", "BMW", "Mercedes", "Merceds", "Porsche", "Jaguar", "Lucid", "Aston")
TECHNICAL = ("Tesla", "Hyundai", "Kia", "Volkswagen", "VW", "Volvo", "Ford", "Chevrolet")
#: Words that tell of energy use.
ENERGY_WORDS = ("油耗", "能耗", "省油", "低使用成本")
#: Domain of a note by the first word that its name holds.
DOMAINS = {"选购": "选购指南", "技术": "能源路线", "纯电": "能源路线", "电池": "电池安全", "充电": "补能续航", "续航": "补能续航", "智能": "智能化", "家庭": "家庭场景", "话术": "销售话术", "竞品": "竞品对比", "合规": "合规规范"}
OTHER_DOMAIN = "通用知识"
#: Steps of a deep search, and the two that some questions add.
TASKS = ["抽取购车画像", "检索新能源知识库", "召回车型库", "计算推荐评分", "生成竞品对比", "生成销售跟进建议", "执行合规检查"]
COMPARE_TASK, RANGE_TASK = "识别用户指定车型并进行参数对比", "检索续航与补能知识"
COMPARE_WORDS, RANGE_WORDS = ("对比", "相比", "怎么选"), ("续航", "长途", "高速")
#: Phrases of a refusal.
REFUSALS = ("无法回答", "不能回答", "请以官方为准")

BRANDS = ["Audi", "Tesla", "Opel", "BMW", "Kia", "Smart"]
RAW = ["SUV", "van", "micro", "passenger_car", "cargo", ""]
SPECS_SQL = f"""spec AS (SELECT p_partkey AS id, {BRANDS}[1 + p_partkey % 6] AS brand, {RAW}[1 + p_partkey // 2 % 6] AS raw, p_size * 2.0::DOUBLE AS battery, p_partkey % 13 * 30.0::DOUBLE AS power, 2018 + p_partkey % 9 AS year,
  CASE WHEN p_partkey % 11 = 0 THEN 'ID Buzz' ELSE 'M' || p_partkey END AS model, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 10 END AS range_km FROM part)"""


def specs(spark, d):
    """Parts seen as rows of a public specification source."""
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    return t(spark, d, "part").select(
        k.alias("id"), pick(BRANDS, k).alias("brand"), pick(RAW, F.floor(k / 2)).alias("raw"), (F.col("p_size") * 2.0).alias("battery"), (k % 13 * 30.0).alias("power"), (2018 + k % 9).alias("year"),
        F.when(k % 11 == 0, "ID Buzz").otherwise(F.concat(F.lit("M"), k.cast("string"))).alias("model"), F.when(k % 7 == 0, 0).otherwise(F.col("p_size") * 10).alias("range_km"),
    )


def vehicle_type(raw):
    """Catalog type of a source's type."""
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(known[F.lower(F.coalesce(raw, F.lit("")))], F.lit(OTHER_TYPE))


def imputed(df):
    """Seats, wheelbase, boot, safety and assistance of specification rows that lack them."""
    kind, luxury, technical = F.col("vehicle_type"), F.col("brand").isin(*LUXURY), F.col("brand").isin(*TECHNICAL)
    words = F.lower("model")
    seats = F.when((kind == "MPV") | F.contains(words, F.lit("buzz")) | F.contains(words, F.lit("eqv")) | F.contains(F.lower("raw"), F.lit("van")), 7).when(kind == "微型车", 4).otherwise(5)
    base = F.when(kind == "SUV", 2920).when(kind == "MPV", 3100).when(kind == "微型车", 2450).otherwise(2860) + F.when(luxury, 80).otherwise(0)
    size = F.when(F.col("battery") >= 90, 90).when((F.col("battery") < 45) & (F.col("battery") > 0), -140).otherwise(0)
    tenths = 44 + F.when(luxury | technical, 2).otherwise(0) + F.when(F.col("power") > 250, 1).otherwise(0) + F.when(F.col("year") >= 2024, 1).otherwise(0)
    out = df.withColumn("seats", seats)
    boot = F.when(F.col("seats") >= 7, 380).when(kind == "SUV", 520).when(kind == "微型车", 260).otherwise(470)
    return out.select("*", (base + size).alias("wheelbase"), boot.alias("trunk"), (F.least(tenths, F.lit(49)) / 10).alias("safety"), F.when((F.col("year") >= 2024) & (luxury | technical), "L2+").otherwise("L2").alias("adas"))


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TYPE_SQL = "CASE lower(raw) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + f" ELSE '{OTHER_TYPE}' END"


@query("imputed_fields", f"""WITH {SPECS_SQL}, k AS (SELECT *, {TYPE_SQL} AS vt, brand IN {_in(LUXURY)} AS lux, brand IN {_in(LUXURY + TECHNICAL)} AS known FROM spec),
s AS (SELECT *, CASE WHEN vt = 'MPV' OR contains(lower(model), 'buzz') OR contains(lower(model), 'eqv') OR contains(lower(raw), 'van') THEN 7 WHEN vt = '微型车' THEN 4 ELSE 5 END AS seats FROM k)
SELECT id, vt AS vehicle_type, seats, CASE vt WHEN 'SUV' THEN 2920 WHEN 'MPV' THEN 3100 WHEN '微型车' THEN 2450 ELSE 2860 END + CASE WHEN lux THEN 80 ELSE 0 END + CASE WHEN battery >= 90 THEN 90 WHEN battery < 45 AND battery > 0 THEN -140 ELSE 0 END AS wheelbase,
  CASE WHEN seats >= 7 THEN 380 WHEN vt = 'SUV' THEN 520 WHEN vt = '微型车' THEN 260 ELSE 470 END AS trunk, least(44 + CASE WHEN known THEN 2 ELSE 0 END + CASE WHEN power > 250 THEN 1 ELSE 0 END + CASE WHEN year >= 2024 THEN 1 ELSE 0 END, 49) / 10.0::DOUBLE AS safety,
  CASE WHEN year >= 2024 AND known THEN 'L2+' ELSE 'L2' END AS adas FROM s""")
def imputed_fields(spark, d):
    """Type mapping and the rule tables for fields a source lacks."""
    return imputed(specs(spark, d).withColumn("vehicle_type", vehicle_type(F.col("raw")))).select("id", "vehicle_type", "seats", "wheelbase", "trunk", "safety", "adas")


@query("recommender_projection", f"""WITH {SPECS_SQL} SELECT id, brand, model, {TYPE_SQL} AS vehicle_type, 150000 AS price_min, 450000 AS price_max, coalesce(nullif(range_km, 0), 400) AS cltc_range, coalesce(nullif(battery, 0), 60.0::DOUBLE) AS battery_kwh, CASE WHEN {TYPE_SQL} = 'MPV' THEN 7 ELSE 5 END AS seats,
'未知' AS drive_type, 'L2' AS adas_level, CASE WHEN {TYPE_SQL} = 'SUV' THEN 2850 ELSE 2750 END AS wheelbase, 480 AS trunk_volume, 4.5::DOUBLE AS safety_score FROM spec""")
def recommender_projection(spark, d):
    """Specification rows as catalog rows: constants and defaults where the source has none or zero."""
    s = specs(spark, d).withColumn("vehicle_type", vehicle_type(F.col("raw")))
    lit = lambda v, n: F.lit(v).alias(n)
    return s.select("id", "brand", "model", "vehicle_type", lit(150000, "price_min"), lit(450000, "price_max"), F.coalesce(F.nullif("range_km", F.lit(0)), F.lit(400)).alias("cltc_range"), F.coalesce(F.nullif("battery", F.lit(0.0)), F.lit(60.0)).alias("battery_kwh"),
                    F.when(F.col("vehicle_type") == "MPV", 7).otherwise(5).alias("seats"), lit("未知", "drive_type"), lit("L2", "adas_level"), F.when(F.col("vehicle_type") == "SUV", 2850).otherwise(2750).alias("wheelbase"), lit(480, "trunk_volume"), lit(4.5, "safety_score"))


RATED = "array<struct<cycle:string,range_km:double>>"


@query("nested_ranges", """WITH j AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 5 = 1 THEN [{'cycle': 'nedc', 'range_km': 500.0::DOUBLE}, {'cycle': 'wltp', 'range_km': p_size * 10.0::DOUBLE}] WHEN p_partkey % 5 = 2 THEN [{'cycle': 'cltc', 'range_km': 0.0::DOUBLE}, {'cycle': 'nedc', 'range_km': 310.9::DOUBLE}]
ELSE [{'cycle': 'epa', 'range_km': p_size + 0.7::DOUBLE}, {'cycle': 'cltc', 'range_km': 600.0::DOUBLE}] END AS rated, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'https://x/' || p_partkey END AS url FROM part),
o AS (SELECT id, url, list_filter(list_concat(list_filter(rated, lambda r: r.cycle IN ('cltc', 'wltp', 'epa')), list_filter(rated, lambda r: r.cycle NOT IN ('cltc', 'wltp', 'epa'))), lambda r: r.range_km <> 0) AS r FROM j)
SELECT id, coalesce(CAST(trunc(r[1].range_km) AS INT), 0) AS range_km, coalesce(r[1].cycle, '') AS cycle, coalesce(url, '') AS source_url FROM o""")
def nested_ranges(spark, d):
    """First usable range of a nested list, known cycles before others, and a nested link; defaults where a path ends early."""
    k, rated = F.col("p_partkey"), lambda *items: F.array(*(F.struct(F.lit(c).alias("cycle"), F.lit(r).cast("double").alias("range_km") if not hasattr(r, "cast") else r.cast("double").alias("range_km")) for c, r in items)).cast(RATED)
    size = F.col("p_size")
    lists = F.when(k % 5 == 0, F.array().cast(RATED)).when(k % 5 == 1, rated(("nedc", 500.0), ("wltp", size * 10.0))).when(k % 5 == 2, rated(("cltc", 0.0), ("nedc", 310.9))).otherwise(rated(("epa", size + 0.7), ("cltc", 600.0)))
    known = lambda r: r["cycle"].isin("cltc", "wltp", "epa")
    nested = t(spark, d, "part").select(k.alias("id"), F.struct(F.struct(lists.alias("rated")).alias("range"), F.when(k % 3 != 0, F.array(F.struct(F.concat(F.lit("https://x/"), k.cast("string")).alias("url")))).alias("sources")).alias("doc"))
    ordered = F.filter(F.concat(F.filter("doc.range.rated", known), F.filter("doc.range.rated", lambda r: ~known(r))), lambda r: r["range_km"] != 0)
    first = F.try_element_at(ordered, F.lit(1))
    return nested.select("id", F.coalesce(first["range_km"].cast("int"), F.lit(0)).alias("range_km"), F.coalesce(first["cycle"], F.lit("")).alias("cycle"), F.coalesce(F.try_element_at("doc.sources", F.lit(1))["url"], F.lit("")).alias("source_url"))


def wan(c):
    """Ten thousands with at most two decimals."""
    return F.regexp_replace(F.regexp_replace((c / 10000).cast("decimal(18,2)").cast("string"), "0+$", ""), "\\.$", "")


def _any_sql(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _any(c, words):
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


WAN_SQL = "regexp_replace(regexp_replace(CAST(CAST({} / 10000.0 AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '')"


@query("evidence_cards", f"""WITH {CARS_SQL} SELECT id, brand || model AS full_name, {WAN_SQL.format('price_min')} || '-' || {WAN_SQL.format('price_max')} || '万' AS price, cltc_range || 'km' AS reach, seats || '座' AS seats, wheelbase || 'mm' AS wheelbase, monthly_sales || '辆/月' AS sales,
array_to_string(list_filter(list_transform(string_split(suitable_scenarios || ';' || highlights, ';'), lambda x: trim(x)), lambda x: x <> '' AND {_any_sql('x', ENERGY_WORDS)}), '|') AS energy_evidence FROM car""")
def evidence_cards(spark, d):
    """Display strings with units, and the highlights that tell of energy use."""
    c = cars(spark, d)
    unit = lambda n, u, out=None: F.concat(F.col(n).cast("string"), F.lit(u)).alias(out or n)
    items = F.transform(F.split(F.concat_ws(";", "suitable_scenarios", "highlights"), ";"), F.trim)
    return c.select("id", F.concat("brand", "model").alias("full_name"), F.concat(wan(F.col("price_min")), F.lit("-"), wan(F.col("price_max")), F.lit("万")).alias("price"), unit("cltc_range", "km", "reach"), unit("seats", "座"), unit("wheelbase", "mm"), unit("monthly_sales", "辆/月", "sales"),
                    F.array_join(F.filter(items, lambda x: (x != "") & _any(x, ENERGY_WORDS)), "|").alias("energy_evidence"))


@query("display_values", """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '未识别' ELSE CAST(CAST(round(c_custkey % 50 * 9000 / 10000.0::DOUBLE) AS BIGINT) AS VARCHAR) || '万' END AS budget, CASE WHEN c_custkey % 4 = 0 THEN '未识别' ELSE c_custkey % 90 || '公里/天' END AS commute, CASE WHEN c_custkey % 5 = 0 THEN '未识别' ELSE c_custkey % 5 || '人' END AS family,
CASE c_custkey % 3 WHEN 0 THEN '未识别' WHEN 1 THEN '有家充/固定车位' ELSE '无家充/不确定可安装' END AS charger, CASE WHEN c_custkey % 2 = 0 THEN '未识别' ELSE '空间、' || c_mktsegment END AS concerns FROM customer""")
def display_values(spark, d):
    """Profile fields as display text; what was not said reads as not recognised."""
    k, none = F.col("c_custkey"), F.lit("未识别")
    shown = lambda value, text: F.coalesce(F.when(value.isNotNull(), text), none)
    budget = F.when(k % 6 != 0, k % 50 * 9000)
    commute, family = F.when(k % 4 != 0, k % 90), F.when(k % 5 != 0, k % 5)
    charger, concerns = F.when(k % 3 == 1, True).when(k % 3 == 2, False), F.when(k % 2 != 0, F.array(F.lit("空间"), F.col("c_mktsegment")))
    return t(spark, d, "customer").select("c_custkey", shown(budget, F.concat(F.round(budget / 10000).cast("long").cast("string"), F.lit("万"))).alias("budget"), shown(commute, F.concat(commute.cast("string"), F.lit("公里/天"))).alias("commute"), shown(family, F.concat(family.cast("string"), F.lit("人"))).alias("family"),
                                          shown(charger, F.when(charger, "有家充/固定车位").otherwise("无家充/不确定可安装")).alias("charger"), shown(concerns, F.array_join(concerns, "、")).alias("concerns"))


@query("claim_lines", """SELECT p_brand, string_agg('- ' || p_name || ' | ' || p_type || ' | ' || p_size || 'cm | source=part:' || p_partkey, chr(10) ORDER BY p_partkey) AS evidence, CAST(count(*) AS BIGINT) AS claims, array_to_string(list(p_name ORDER BY p_partkey)[1:3], '；') AS label FROM part WHERE p_size <= 3 GROUP BY p_brand""")
def claim_lines(spark, d):
    """One evidence text for each group, a line for each claim, and a label of its first three."""
    line = F.concat(F.lit("- "), F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit(" | "), F.col("p_size").cast("string"), F.lit("cm | source=part:"), F.col("p_partkey").cast("string"))
    claims = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"), "p_name")))
    g = t(spark, d, "part").where("p_size <= 3").groupBy("p_brand").agg(claims.alias("c"))
    return g.select("p_brand", F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("evidence"), F.size("c").cast("long").alias("claims"), F.array_join(F.slice(F.transform("c", lambda x: x["p_name"]), 1, 3), "；").alias("label"))


@query("chart_points", f"WITH {CARS_SQL} SELECT id, CAST(round((price_min + price_max) / 20000.0::DOUBLE) AS BIGINT) AS x, cltc_range AS y, brand || ' ' || model AS name FROM car")
def chart_points(spark, d):
    """Middle price in ten thousands, range and name."""
    return cars(spark, d).select("id", F.round((F.col("price_min") + F.col("price_max")) / 20000).cast("long").alias("x"), F.col("cltc_range").alias("y"), F.concat_ws(" ", "brand", "model").alias("name"))


TITLES = ["家庭选购手册", "纯电技术路线", "电池与充电", "冬季续航", "智能座舱", "家庭出行", "销售话术", "竞品分析", "合规要点", "杂谈"]
QUESTIONS = ["小鹏 G6和 宋L 怎么选？", "续航对比", "高速长途舒服吗", "推荐一款 SUV，空间大；（静音）", "A 怎么选？", "问界M7 与 M9 相比、续航+补能"]
TEXTS_SQL = f"q AS (SELECT c_custkey, {TITLES}[1 + c_custkey % {len(TITLES)}] AS title, {QUESTIONS}[1 + c_custkey % {len(QUESTIONS)}] AS ask FROM customer)"


def texts(spark, d):
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return t(spark, d, "customer").select(k, pick(TITLES).alias("title"), pick(QUESTIONS).alias("ask"))


DOMAIN_SQL = "CASE " + " ".join(f"WHEN contains(title, '{w}') THEN '{v}'" for w, v in DOMAINS.items()) + f" ELSE '{OTHER_DOMAIN}' END"


@query("question_texts", f"""WITH {TEXTS_SQL}, s AS (SELECT *, contains(ask, '怎么选？') AND contains(split_part(ask, '怎么选？', 1), '和') AS two, split_part(ask, '怎么选？', 1) AS head, {_any_sql('ask', RANGE_WORDS)} AS far, {_any_sql('ask', COMPARE_WORDS)} AS near FROM q)
SELECT c_custkey, {DOMAIN_SQL} AS domain, lower(regexp_replace(ask, '[\\s,，。；;：:\\[\\]（）()、+]+', '', 'g')) AS compact, CASE WHEN two THEN trim(split_part(head, '和', 1)) || '|' || trim(substr(head, instr(head, '和') + 1)) ELSE '' END AS compared,
array_to_string(list_filter(['{TASKS[0]}', '{TASKS[1]}', CASE WHEN far THEN '{RANGE_TASK}' END, '{TASKS[2]}', '{TASKS[3]}', CASE WHEN near THEN '{COMPARE_TASK}' END, '{TASKS[4]}', '{TASKS[5]}', '{TASKS[6]}'], lambda x: x IS NOT NULL), '|') AS tasks FROM s""")
def question_texts(spark, d):
    """Domain by the first word a title holds, compact text, the two compared names, and the steps of a deep search."""
    domain = F.lit(OTHER_DOMAIN)
    for word, value in reversed(DOMAINS.items()):
        domain = F.when(F.contains("title", F.lit(word)), value).otherwise(domain)
    head = F.substring_index("ask", "怎么选？", 1)
    left = F.substring_index(head, "和", 1)
    two = F.contains("ask", F.lit("怎么选？")) & F.contains(head, F.lit("和"))
    names = F.when(two, F.array(F.trim(left), F.trim(F.substr(head, F.length(left) + 2)))).otherwise(F.array().cast("array<string>"))
    tasks = F.array(*map(F.lit, TASKS))
    tasks = F.when(_any(F.col("ask"), COMPARE_WORDS), F.array_insert(tasks, 5, F.lit(COMPARE_TASK))).otherwise(tasks)
    tasks = F.when(_any(F.col("ask"), RANGE_WORDS), F.array_insert(tasks, 3, F.lit(RANGE_TASK))).otherwise(tasks)
    return texts(spark, d).select("c_custkey", domain.alias("domain"), X.compact_text(F.col("ask")).alias("compact"), F.array_join(names, "|").alias("compared"), F.array_join(tasks, "|").alias("tasks"))


@query("compact_nfkc")
def compact_nfkc(spark, d):
    """NFKC, case folded, without any white space (no SQL counterpart)."""
    return t(spark, d, "benchmark").select("item_id", F.sha2(F.replace(X.nfkc_key("text"), F.lit(" "), F.lit("")), 256).alias("digest"))


@query("response_flags", f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN FALSE ELSE NOT (starts_with(ltrim(text), '{{') OR starts_with(ltrim(text), '[')) END AS protocol_pass, coalesce({_any_sql('text', REFUSALS)}, FALSE) AS refusal, coalesce(trim(text), '') = '' AS empty FROM conversations WHERE role = 'assistant'""")
def response_flags(spark, d):
    """Whether an answer is empty, refuses, or answers with a bare object."""
    text = F.coalesce("text", F.lit(""))
    answers = t(spark, d, "conversations").where("role = 'assistant'")
    bare = F.startswith(F.ltrim(text), F.lit("{")) | F.startswith(F.ltrim(text), F.lit("["))
    return answers.select("conv_id", "turn", ((F.trim(text) != "") & ~bare).alias("protocol_pass"), _any(text, REFUSALS).alias("refusal"), (F.trim(text) == "").alias("empty"))
