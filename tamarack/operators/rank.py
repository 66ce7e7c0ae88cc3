"""Catalog ranking: weighted multi-criteria scores, recall with fallback, and top-k rules with unique tie-breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the seven sub-scores.
WEIGHTS = {"budget": 0.25, "range": 0.20, "space": 0.15, "charging": 0.15, "smart": 0.10, "safety": 0.10, "scenario": 0.05}


def catalog(parts: DataFrame) -> DataFrame:
    """Parts seen as catalog rows."""
    k = F.col("p_partkey")
    energy = F.element_at(F.array(*(F.lit(e) for e in ("electric", "plugin", "extender", "fuel"))), (k % 4 + 1).cast("int"))
    return parts.select(
        "p_partkey", "p_brand", "p_name", "p_type", "p_size", F.col("p_retailprice").alias("price"), energy.alias("energy"),
        (F.col("p_size") * 10 + 300).alias("range_km"), (k % 4 + 4).cast("int").alias("seats"), (F.col("p_size") * 10 + 2600).alias("wheelbase"),
        (k % 3 == 0).alias("assisted"), (k % 25 + 80).cast("double").alias("safety"), (k % 997).alias("monthly_sales"),
    )


CATALOG_SQL = """cat AS (SELECT p_partkey, p_brand, p_name, p_type, p_size, p_retailprice AS price,
  ['electric', 'plugin', 'extender', 'fuel'][CAST(p_partkey % 4 + 1 AS INT)] AS energy, p_size * 10 + 300 AS range_km, CAST(p_partkey % 4 + 4 AS INT) AS seats,
  p_size * 10 + 2600 AS wheelbase, p_partkey % 3 = 0 AS assisted, CAST(p_partkey % 25 + 80 AS DOUBLE) AS safety, p_partkey % 997 AS monthly_sales FROM part)"""


def profiles(customers: DataFrame) -> DataFrame:
    """Customers seen as user profiles; zero and null fall back to defaults."""
    k = F.col("c_custkey")
    kind = F.create_map(*(F.lit(x) for pair in SEGMENT_TYPES.items() for x in pair))[F.col("c_mktsegment")]
    return customers.select(
        "c_custkey", (900 + k % 10 * 10).cast("double").alias("budget"), F.coalesce(F.nullif((k % 5).cast("int"), F.lit(0)), F.lit(3)).alias("family"),
        F.coalesce(F.nullif((k % 7 * 20).cast("int"), F.lit(0)), F.lit(40)).alias("commute"), kind.alias("pref_type"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("home_charger"),
    )


#: Market segment -> preferred catalog type.
SEGMENT_TYPES = {"AUTOMOBILE": "LARGE", "BUILDING": "STANDARD", "FURNITURE": "MEDIUM", "HOUSEHOLD": "SMALL", "MACHINERY": "ECONOMY"}
PROFILE_SQL = """prof AS (SELECT c_custkey, CAST(900 + c_custkey % 10 * 10 AS DOUBLE) AS budget, coalesce(nullif(CAST(c_custkey % 5 AS INT), 0), 3) AS family,
  coalesce(nullif(CAST(c_custkey % 7 * 20 AS INT), 0), 40) AS commute,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'LARGE' WHEN 'BUILDING' THEN 'STANDARD' WHEN 'FURNITURE' THEN 'MEDIUM' WHEN 'HOUSEHOLD' THEN 'SMALL' WHEN 'MACHINERY' THEN 'ECONOMY' END AS pref_type,
  CASE WHEN c_custkey % 3 = 0 THEN TRUE WHEN c_custkey % 3 = 1 THEN FALSE END AS home_charger FROM customer)"""


def sub_scores() -> dict[str, F.Column]:
    """The seven sub-scores of a (profile, catalog row) pair, unrounded."""
    b, price = F.col("budget"), F.col("price")
    room = F.when(F.col("family") >= 4, F.when((F.col("seats") >= 5) & (F.col("wheelbase") >= 2900), 10).otherwise(-5)).otherwise(0)
    space = 75 + room + F.when(F.col("p_type").isin("LARGE", "MEDIUM"), 10).otherwise(0)
    charge = (
        F.when(F.col("energy") == "fuel", 82)
        .when(F.col("home_charger").isNull(), 82)
        .when(F.col("home_charger"), F.when(F.col("energy") == "electric", 92).otherwise(84))
        .otherwise(F.when(F.col("energy").isin("plugin", "extender"), 94).otherwise(72))
    )
    return {
        "budget": F.when(price <= b, 100 - F.greatest((price - b) / b * 40, F.lit(0.0))).otherwise(F.greatest(F.lit(30.0), 100 - F.abs(price - b) / b * 100)),
        "range": F.when(F.col("energy") == "fuel", 86.0).otherwise(F.least(F.col("range_km") / F.greatest(F.col("commute") * 7, F.lit(350)) * 100, F.lit(100.0))),
        "space": F.greatest(F.lit(40), F.least(F.lit(100), space)).cast("double"),
        "charging": charge.cast("double"),
        "smart": F.when(F.col("assisted"), 92.0).otherwise(78.0),
        "safety": F.least(F.col("safety"), F.lit(100.0)),
        "scenario": F.least(75.0 + F.when(F.col("p_type") == F.col("pref_type"), 8.0).otherwise(0.0), F.lit(100.0)),
    }


SCORE_SQL = """greatest(0.0, least(100.0,
  (CASE WHEN price <= budget THEN 100 - greatest((price - budget) / budget * 40, 0.0) ELSE greatest(30.0, 100 - abs(price - budget) / budget * 100) END) * 0.25::DOUBLE
  + (CASE WHEN energy = 'fuel' THEN 86.0::DOUBLE ELSE least(range_km / greatest(commute * 7, 350) * 100, 100.0::DOUBLE) END) * 0.2::DOUBLE
  + CAST(greatest(40, least(100, 75 + CASE WHEN family >= 4 THEN CASE WHEN seats >= 5 AND wheelbase >= 2900 THEN 10 ELSE -5 END ELSE 0 END + CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 10 ELSE 0 END)) AS DOUBLE) * 0.15::DOUBLE
  + CAST(CASE WHEN energy = 'fuel' THEN 82 WHEN home_charger IS NULL THEN 82 WHEN home_charger THEN CASE WHEN energy = 'electric' THEN 92 ELSE 84 END ELSE CASE WHEN energy IN ('plugin', 'extender') THEN 94 ELSE 72 END END AS DOUBLE) * 0.15::DOUBLE
  + (CASE WHEN assisted THEN 92.0::DOUBLE ELSE 78.0::DOUBLE END) * 0.1::DOUBLE
  + least(safety, 100.0::DOUBLE) * 0.1::DOUBLE
  + least(75.0::DOUBLE + CASE WHEN p_type = pref_type THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END, 100.0::DOUBLE) * 0.05::DOUBLE
  + CASE WHEN p_type = pref_type THEN 10.0::DOUBLE ELSE -10.0::DOUBLE END))"""


def weighted_score() -> F.Column:
    """Clipped weighted total with the type bonus; sub-scores enter unrounded."""
    total = None
    for name, part in sub_scores().items():
        term = part * F.lit(WEIGHTS[name])
        total = term if total is None else total + term
    bonus = F.when(F.col("p_type") == F.col("pref_type"), 10.0).otherwise(-10.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total + bonus))


def recall(pairs: DataFrame, key: list[str], keep: F.Column) -> DataFrame:
    """Rows of a key that pass ``keep``; all rows of a key of which none passes."""
    hit = F.max(F.when(keep, 1).otherwise(0)).over(W.partitionBy(*key))
    return pairs.withColumn("any_hit", hit).where((F.col("any_hit") == 0) | keep).drop("any_hit")


def top_k(df: DataFrame, key: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in a total order, with their 1-based rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def rank_profiles(customers: DataFrame, parts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best catalog rows of every customer.

    Customers with equal profiles are ranked once, so the number of scored pairs follows the number of
    different profiles. Candidates meet profiles by an equi-join on the preferred type.
    """
    who = profiles(customers)
    fields = [c for c in who.columns if c != "c_custkey"]
    distinct = who.select(*fields).distinct()
    pairs = distinct.join(catalog(parts), (F.col("p_type") == F.col("pref_type")) & (F.col("price") <= F.col("budget") * 1.25))
    best = top_k(pairs.withColumn("raw", weighted_score()), fields, [F.desc("raw"), F.desc("monthly_sales"), "p_partkey"], k)
    same = None
    for c in fields:
        term = F.col(f"w.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = term if same is None else same & term
    return who.alias("w").join(best.alias("b"), same).select("c_custkey", "rank", "p_partkey", F.round("raw", 1).alias("score"))


def with_source_quota(df: DataFrame, key: list[str], source: str, wanted: str, order: list, k: int) -> DataFrame:
    """Top-k in which the last place goes to the best row of source ``wanted`` if none made it by itself."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    own = F.row_number().over(W.partitionBy(*key, source).orderBy(*order))
    ranked = df.withColumn("place", place).withColumn("own", own)
    inside = F.max(F.when((F.col(source) == wanted) & (F.col("place") <= k), 1).otherwise(0)).over(W.partitionBy(*key))
    there = F.max(F.when(F.col(source) == wanted, 1).otherwise(0)).over(W.partitionBy(*key))
    ranked = ranked.withColumn("forced", (inside == 0) & (there == 1))
    keep = F.when(F.col("forced"), (F.col("place") < k) | ((F.col(source) == wanted) & (F.col("own") == 1))).otherwise(F.col("place") <= k)
    return ranked.where(keep).withColumn("rank", F.least(F.col("place"), F.lit(k))).drop("place", "own", "forced")


def union_first_wins(frames: list[DataFrame], key: F.Column, order: list) -> DataFrame:
    """Union in which the first frame's row of a key wins, then the first in ``order``."""
    stacked = None
    for i, f in enumerate(frames):
        f = f.withColumn("source_rank", F.lit(i))
        stacked = f if stacked is None else stacked.unionByName(f)
    return stacked.withColumn("k", key).withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("source_rank", *order))).where("n = 1").drop("n", "k")
