"""Profiles read from questions, and the decisions made from them, as column expressions.

Null questions count as empty. A category that no word hits is null; a list that no word hits is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import once

#: Words of a question and what they stand for, in the order in which they are tried.
BUDGET = r"([0-9]+(?:\.[0-9]+)?)\s*(万|w|W)"
COMMUTE = r"通勤.*?([0-9]+(?:\.[0-9]+)?)\s*(公里|km|KM)"
HOUSEHOLD = r"([0-9])\s*(口|人|个).*?(家|家庭)"
CITY = r"(?:在|坐标|城市|常住地|上牌地)\s*([\x{4e00}-\x{9fa5}]{2,4})(?:市|通勤|用车|上牌|$)"
NO_CHARGER = ["没有家充", "不能装充电桩", "无家充", "没法装充电桩", "没有固定车位"]
CHARGER = ["家充", "充电桩", "固定车位"]
TYPES = ["SUV", "轿车", "MPV", "旅行车", "猎装车", "跑车", "轿跑"]
LUXURY = "豪车"
ENERGIES = {"纯电": ["纯电"], "插混": ["插混", "混动"], "增程": ["增程"]}
SOCIAL = ["撩妹", "泡妞", "约会", "面子", "牌面", "社交"]
SOCIAL_CONCERNS = ["社交形象", "内饰氛围", "品牌"]
CONCERNS = {
    "续航": ["续航", "长途", "高速"],
    "能耗": ["能耗", "电耗", "油耗", "馈电", "亏电", "能效"],
    "安全": ["安全", "电池", "自燃"],
    "智驾": ["智驾", "辅助驾驶", "智能驾驶", "NOA"],
    "空间": ["空间", "后排", "后备箱", "小孩", "家庭"],
    "性价比": ["性价比", "便宜", "价格敏感", "预算有限", "低价"],
    "补能": ["充电", "家充", "补能", "快充"],
    "保值": ["保值", "二手"],
}
BRANDS = ["比亚迪", "特斯拉", "小鹏", "理想", "问界", "享界", "尊界", "智界", "蔚来", "极氪", "吉利", "长安", "大众", "宝马", "奔驰", "奥迪", "小米", "阿维塔"]
INTENT_LEVELS = {"高意向": ["试驾", "近期买", "准备买", "订车"], "对比中": ["对比", "纠结", "怎么选", "哪个更适合", "哪款更适合"]}
ROUTES = {"compare": ["对比", "相比", "怎么选", "差异"], "sales": ["话术", "客户", "销售", "异议"], "recommend": ["推荐", "买", "预算", "家用", "通勤"]}
SCENES = {
    "social_luxury": ["泡妞", "撩妹", "约会", "社交", "面子", "牌面", "豪车", "跑车", "轿跑", "性能车", "amg", "保时捷", "m2"],
    "family_commute": ["三口", "家庭", "家用", "小孩", "通勤", "空间", "suv", "露营"],
}
REAL_HINTS = ["真实数据", "公开数据", "海外", "欧洲", "美国", "Open EV", "数据库", "参数", "规格", "年份", "Tesla", "BMW", "Audi", "Volkswagen", "Porsche"]
LOCAL_HINTS = ["销售", "中国", "国内", "门店", "试驾", "家庭", "通勤", "置换", "预算", "新能源"]
COMPLEX_HINTS = ["对比", "纠结", "怎么选", "哪款", "兼顾", "综合", "不确定"]
MARK = r"[A-Za-z0-9\x{4e00}-\x{9fa5}-]+"
SPACE = r"[\s\p{Zs}]"
VEHICLES = [
    f"Model{SPACE}*3",
    f"Model{SPACE}*Y{SPACE}*L",
    f"Model{SPACE}*Y",
    rf"BMW{SPACE}*i?[\p{{L}}\p{{N}}_-]+",
    *(f"{brand}{SPACE}*{MARK}" for brand in ("奔驰", "宝马", "问界", "享界", "尊界", "小鹏", "理想")),
]
MAX_VEHICLES = 6
TITLE_MODELS = [
    rf"(BMW|宝马){SPACE}*([A-Za-z0-9系]+)",
    rf"(Mercedes|奔驰){SPACE}*([A-Za-z0-9级]+)",
    rf"(Porsche|保时捷){SPACE}*([A-Za-z0-9]+)",
    rf"(Tesla|特斯拉){SPACE}*(Model{SPACE}*[A-Za-z0-9]+)",
    rf"(Polestar|极星){SPACE}*([A-Za-z0-9]+)",
    rf"(MG|名爵){SPACE}*([A-Za-z0-9]+)",
    rf"(蔚来|小米|阿维塔|智界|享界|尊界|问界|极氪|腾势){SPACE}*([A-Za-z0-9]+)",
]
MAX_TITLE_MODELS = 4


def has_any(c, words: list[str]):
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def first_hit(c, words_of: dict[str, list[str]]):
    """The first label with a word in ``c``; null if there is none."""
    return F.coalesce(*(F.when(has_any(c, words), label) for label, words in words_of.items()))


def all_hits(c, words_of: dict[str, list[str]]):
    return F.array_compact(F.array(*(F.when(has_any(c, words), label) for label, words in words_of.items())))


def _number(c, pattern: str):
    """Group 1 as a number; no match and zero are null."""
    return F.nullif(F.regexp_extract(c, pattern, 1).try_cast("double"), F.lit(0.0))


def with_profile(df: DataFrame, ask: str = "ask", cities: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the fields that the question in ``ask`` gives; ``cities`` are names known by themselves."""
    c = F.coalesce(F.col(ask), F.lit(""))
    household = F.coalesce(_number(c, HOUSEHOLD).cast("int"), F.when(F.contains(c, F.lit("三口")), 3), F.when(F.contains(c, F.lit("二胎")), 4))
    named = [F.when(F.contains(c, F.lit(name)), name) for name in cities]
    kind = first_hit(F.lower(c), {x: [x.lower()] for x in TYPES})
    social = F.when(has_any(c, SOCIAL), F.array(*map(F.lit, SOCIAL_CONCERNS))).otherwise(F.array().cast("array<string>"))
    return df.withColumns(
        {
            "budget_max": (_number(c, BUDGET) * 10000).cast("int"),
            "commute_km": _number(c, COMMUTE),
            "family_size": household,
            "city": F.coalesce(*named, F.nullif(F.regexp_extract(c, CITY, 1), F.lit(""))),
            "has_home_charger": F.when(has_any(c, NO_CHARGER), False).when(has_any(c, CHARGER), True),
            "preferred_type": F.coalesce(kind, F.when(F.contains(c, F.lit(LUXURY)), LUXURY)),
            "preferred_energy": first_hit(c, ENERGIES),
            "concerns": F.concat(social, all_hits(c, CONCERNS)),
            "preferred_brands": all_hits(c, {b: [b] for b in BRANDS}),
            "intent_level": first_hit(c, INTENT_LEVELS),
        }
    )


def confidence():
    """Percentage of the six important fields of a profile that are known."""
    known = [F.col(f).isNotNull() for f in ("budget_max", "city", "family_size", "commute_km", "has_home_charger")] + [F.size("concerns") > 0]
    return F.round(sum(k.cast("int") for k in known) / 6 * 100).cast("int")


def route(c):
    return F.coalesce(first_hit(c, ROUTES), F.lit("knowledge"))


def scene(c):
    """Scene of a question together with its preferred type and concerns."""
    words = F.lower(F.concat_ws(" ", c, F.coalesce("preferred_type", F.lit("")), F.array_join("concerns", " ")))
    return F.coalesce(first_hit(words, SCENES), F.lit("general"))


def pool(c, strategy):
    """Candidate pool: an explicit choice, public data, large families, unclear questions, local words, in this order."""
    low, chosen = F.lower(c), F.lower(F.trim(strategy))
    hints = lambda words: has_any(low, [w.lower() for w in words])
    missing = sum(F.col(f).isNull().cast("int") for f in ("budget_max", "family_size", "commute_km", "has_home_charger"))
    large = F.coalesce(F.col("preferred_type") == "MPV", F.lit(False)) | (F.coalesce("family_size", F.lit(0)) >= 5)
    return F.when(chosen.isin("local", "real", "fused"), chosen).when(hints(REAL_HINTS), "real").when(large, "local").when((missing >= 2) | hints(COMPLEX_HINTS), "fused").when(hints(LOCAL_HINTS), "local").otherwise("fused")


def vehicle_mentions(c):
    """Vehicle names of a question by pattern, in the order of the patterns; the first of equal names, six at most."""
    found = F.concat(*(F.regexp_extract_all(c, F.lit(f"(?i)({p})"), F.lit(1)) for p in VEHICLES))
    names = F.transform(found, lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    first = once(names, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, F.lower), F.lower(x)) == i + 1))
    return F.slice(first, 1, MAX_VEHICLES)


def title_models(c, known):
    """Brand and model pairs of a title, by pattern and place: the first of equal names, none of the keys in ``known``, four at most.

    A key is the name in lower case without spaces; null titles have no pairs.
    """
    text = F.coalesce(c, F.lit(""))
    group = lambda p, g: F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(g))
    pairs = F.concat(*(F.zip_with(group(p, 1), group(p, 2), lambda b, m: F.struct(b.alias("brand"), F.replace(m, F.lit(" "), F.lit("")).alias("model"))) for p in TITLE_MODELS))
    key = lambda x: F.lower(F.concat(x["brand"], x["model"]))
    fresh = F.filter(pairs, lambda x: ~F.array_contains(known, key(x)))
    first = once(fresh, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, key), key(x)) == i + 1))
    return F.slice(first, 1, MAX_TITLE_MODELS)
