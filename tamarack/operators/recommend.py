"""Full catalog scoring for profiles: seven sub-scores, bonuses, reasons, cautions, pinned mentions, named rows.

A catalog row has brand, model, vehicle_type, energy_type, price_min, price_max, cltc_range, seats, wheelbase, adas_level,
safety_score, monthly_sales, suitable_scenarios, highlights and weaknesses. A profile has budget_min, budget_max,
family_size, commute_km, has_home_charger, preferred_type, preferred_energy, preferred_brands, concerns and
mentioned_models; null, zero and empty values mean that nothing was said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators.rank import WEIGHTS

#: What counts where a profile says nothing.
BUDGET, BUDGET_MIN, COMMUTE, FAMILY = 300000, 0, 40, 3
#: Brands and words of the social concern.
LUXURY = ("奔驰", "宝马", "奥迪", "享界", "尊界", "蔚来")
LUXURY_WORDS = ("豪华", "商务", "行政", "社交形象")
KNOWN_LUXURY = ("奔驰", "宝马", "奥迪")
TECHNICAL = ("特斯拉", "小米", "阿维塔", "享界", "尊界", "智界")
#: Texts of reasons and cautions.
REASONS = {
    "mentioned": "用户问题中明确点名该车型，已优先纳入对比",
    "no_charger": "无家充场景下补能更稳妥",
    "smart": "智能驾驶能力更贴合关注点",
    "space": "SUV 空间和家庭实用性较强",
    "luxury": "豪华品牌在社交形象和商务场景中识别度更高",
    "technical": "科技品牌和新能源属性更容易体现年轻化与科技感",
}
CAUTIONS = {
    "price": "入门价格高于当前预算，需要确认金融方案或调整预算",
    "charging": "无家充时需要确认公共充电便利性",
    "range": "续航关注度较高，建议试驾并核算实际续航",
}
NAMES = tuple(WEIGHTS)


def said(name: str, otherwise) -> Column:
    """A number of the profile, or the default where it is null or zero."""
    return F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(otherwise))


def holds(array: str, value) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def full_name() -> Column:
    return F.concat_ws(" ", "brand", "model")


def mentioned() -> Column:
    return holds("mentioned_models", full_name())


def _wanted(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _type_fits() -> Column:
    return _wanted("preferred_type") & F.coalesce(F.contains("vehicle_type", "preferred_type"), F.lit(False))


def sub_scores() -> dict[str, Column]:
    """The seven sub-scores, unrounded."""
    most, least = said("budget_max", BUDGET), said("budget_min", BUDGET_MIN)
    middle = (F.col("price_min") + F.col("price_max")) / 2
    distance = (middle - most) / F.greatest(most, F.lit(1))
    overlap = (F.col("price_min") <= most) & (F.col("price_max") >= least)
    family, charger, energy = said("family_size", FAMILY), F.col("has_home_charger"), F.col("energy_type")
    roomy = F.when((F.col("seats") >= 5) & (F.col("wheelbase") >= 2900), 10).otherwise(-5)
    space = 75 + F.when(family >= 4, roomy).otherwise(0) + F.when(F.col("vehicle_type").isin("SUV", "MPV"), 10).otherwise(0)
    text = F.concat_ws(";", "suitable_scenarios", "highlights", "brand", "model")
    found = F.coalesce(F.size(F.filter("concerns", lambda c: F.contains(text, c))), F.lit(0))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    scenario = 75 + 5 * F.greatest(found, F.lit(0)) + points(_type_fits(), 8) + points(_wanted("preferred_energy") & (F.col("preferred_energy") == energy), 8)
    scenario = scenario + points(holds("preferred_brands", F.col("brand")), 8) + points(mentioned(), 24)
    return {
        "budget": F.when(mentioned(), 88.0).when(overlap, 100 - F.greatest(distance * 40, F.lit(0.0))).otherwise(F.greatest(F.lit(30.0), 100 - F.abs(distance) * 100)),
        "range": F.when(energy == "燃油", 86.0).otherwise(F.least(F.col("cltc_range") / F.greatest(said("commute_km", COMMUTE) * 7, F.lit(350)) * 100, F.lit(100.0))),
        "space": F.least(F.greatest(space, F.lit(40)), F.lit(100)).cast("double"),
        "charging": F.when((energy == "燃油") | charger.isNull(), 82.0).when(charger, F.when(energy == "纯电", 92.0).otherwise(84.0)).otherwise(F.when(energy.isin("插混", "增程"), 94.0).otherwise(72.0)),
        "smart": F.when(F.contains("adas_level", F.lit("+")), 92.0).otherwise(78.0) + F.when(holds("concerns", "智驾"), 6.0).otherwise(0.0),
        "safety": F.least(F.col("safety_score").cast("double"), F.lit(100.0)),
        "scenario": F.least(scenario, F.lit(100)).cast("double"),
    }


def bonus() -> Column:
    """Points after the weighted sum: type, social image, families in vans."""
    kind = F.when(~_wanted("preferred_type"), 0).when(_type_fits(), 10).otherwise(-10)
    text = F.concat_ws(";", "brand", "suitable_scenarios", "highlights")
    social = F.when(F.col("brand").isin(*LUXURY), 22).when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in LUXURY_WORDS)), 12).otherwise(0)
    return kind + F.when(holds("concerns", "社交形象"), social).otherwise(0) + F.when((said("family_size", FAMILY) >= 4) & (F.col("vehicle_type") == "MPV"), 10).otherwise(0)


def reasons(parts: dict[str, Column]) -> Column:
    """Texts for a row, in their fixed order."""
    points = lambda label, name: F.concat(F.lit(f"{label}匹配度 "), rounded(parts[name], 0).cast("long").cast("string"), F.lit(" 分"))
    social = F.when(F.col("brand").isin(*KNOWN_LUXURY), REASONS["luxury"]).when(F.col("brand").isin(*TECHNICAL), REASONS["technical"])
    listed = [
        F.when(mentioned(), REASONS["mentioned"]),
        points("预算", "budget"),
        points("续航", "range"),
        points("空间", "space"),
        F.when(~F.col("has_home_charger") & F.col("energy_type").isin("插混", "增程"), REASONS["no_charger"]),
        F.when(holds("concerns", "智驾") & F.contains("adas_level", F.lit("+")), REASONS["smart"]),
        F.when(holds("concerns", "空间") & (F.col("vehicle_type") == "SUV"), REASONS["space"]),
        F.when(holds("concerns", "社交形象"), social),
    ]
    return F.array_compact(F.array(*listed))


def cautions(most: int = 3) -> Column:
    """At most ``most`` warnings, in their fixed order."""
    listed = [
        F.when(F.col("price_min") > said("budget_max", BUDGET), CAUTIONS["price"]),
        F.when((F.col("energy_type") == "纯电") & ~F.col("has_home_charger"), CAUTIONS["charging"]),
        F.when((F.col("cltc_range") < 550) & holds("concerns", "续航"), CAUTIONS["range"]),
        F.when(F.col("weaknesses") != "", F.col("weaknesses")),
    ]
    return F.slice(F.array_compact(F.array(*listed)), 1, most)


def rounded(x: Column, places: int) -> Column:
    """Half up; through six decimals, so that a sum of decimals rounds by its decimal value and not by its last binary digit."""
    return F.round(F.round(x, 6), places)


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs of a profile and a catalog row with score, seven rounded sub-scores, reasons, cautions and ``is_mentioned``.

    The total takes the unrounded sub-scores. ``safety_score`` becomes the sub-score.
    """
    parts = sub_scores()
    total = reduce(lambda a, b: a + b, (parts[n] * F.lit(w) for n, w in WEIGHTS.items())) + bonus()
    subs = [rounded(F.least(parts[n], F.lit(100.0)) if n == "smart" else parts[n], 1).alias(f"{n}_score") for n in NAMES]
    taken = {f"{n}_score" for n in NAMES}
    return pairs.select(*(c for c in pairs.columns if c not in taken), rounded(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 1).alias("score"), *subs, reasons(parts).alias("reasons"), cautions().alias("cautions"), mentioned().alias("is_mentioned"))


def recommend(profiles: DataFrame, catalog: DataFrame, key: str, id_col: str, k: int = 5) -> DataFrame:
    """The ``k`` best rows of every profile, mentioned models first, then by score, sales and id.

    ``profiles`` is a stated set of questions: it meets every catalog row, and only the best rows leave a task.
    """
    order = [F.desc("is_mentioned"), F.desc("score"), F.desc("monthly_sales"), F.col(id_col)]
    ranked = scored(catalog.crossJoin(F.broadcast(profiles))).withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def recalled(pairs: DataFrame, key: str) -> DataFrame:
    """Candidates of a profile: its mentioned models if it names any; else the rows that fit budget, type and energy, or all if none does."""
    names = F.coalesce(F.size("mentioned_models"), F.lit(0)) > 0
    cheap = F.col("budget_max").isNull() | (F.col("budget_max") == 0) | (F.col("price_min") <= F.col("budget_max") * 1.25)
    fits = cheap & (~_wanted("preferred_type") | _type_fits()) & (~_wanted("preferred_energy") | (F.col("preferred_energy") == F.col("energy_type")))
    marked = pairs.withColumn("fits", F.coalesce(F.when(names, mentioned()).otherwise(fits), F.lit(False))).withColumn("names", names)
    some = marked.groupBy(F.col(key).alias("some_key")).agg(F.max("fits").alias("some"))
    return marked.join(F.broadcast(some), F.col(key) == F.col("some_key")).where("fits or not (names or some)").drop("fits", "names", "some", "some_key")


def named_rows(names: DataFrame, catalog: DataFrame, id_col: str) -> DataFrame:
    """(place, asked, catalog columns) of rows whose full name holds an asked name, or whose model the name holds; case does not matter.

    A row counts for the first name that finds it. ``names`` (place, asked) is a stated list.
    """
    asked, full = F.lower("asked"), F.lower(full_name())
    hits = catalog.join(F.broadcast(names), F.contains(full, asked) | F.contains(asked, F.lower("model")))
    return hits.withColumn("first", F.row_number().over(W.partitionBy(id_col).orderBy("place"))).where("first = 1").drop("first")


def heuristic_score(budget: Column, kind: Column, energy: Column, concerns: Column) -> Column:
    """Score of a catalog row for one parsed question: distance from the budget, type, energy and concerns found."""
    middle = (F.col("price_min") + F.col("price_max")) / 2
    text = F.concat_ws(" ", "highlights", "suitable_scenarios", "adas_level")
    power = F.when(energy.isNull(), 0).when(F.col("energy_type") == energy, 12).when((energy == "插混") & (F.col("energy_type") == "增程"), 4).otherwise(-10)
    found = F.size(F.filter(concerns, lambda c: F.contains(text, c)))
    return 100 - F.least(F.abs(middle - budget) / F.greatest(budget, F.lit(1)) * 20, F.lit(30.0)) + F.when(kind.isNotNull() & F.contains("vehicle_type", kind), 10).otherwise(0) + power + 2 * found
