"""Feedback: recency-weighted aggregates turned into re-ranking rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of an event by its age in days, and of one without a readable time.
AGE_WEIGHTS = ((7, 1.0), (30, 0.85), (90, 0.65))
OLDER, UNREADABLE = 0.45, 0.7


def events_as_feedback(events: DataFrame) -> DataFrame:
    """Driver events seen as feedback: rating by type, model by user, pool by props.k."""
    rating = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "ts", F.col("user_id").alias("model"), rating.alias("rating"), F.concat(F.lit("pool"), (k % 4).cast("string")).alias("pool"), F.array(F.concat(F.lit("s"), (k % 3).cast("string")), F.concat(F.lit("s"), (k % 5).cast("string"))).alias("scenes"), "event_type")


FEEDBACK_SQL = """fb AS (SELECT event_id, ts, user_id AS model, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS rating,
  'pool' || CAST(k % 4 AS VARCHAR) AS pool, ['s' || CAST(k % 3 AS VARCHAR), 's' || CAST(k % 5 AS VARCHAR)] AS scenes, event_type FROM (SELECT *, CAST(props ->> 'k' AS INT) AS k FROM events))"""


def age_weight(ts: F.Column, now: str) -> F.Column:
    """Weight by whole 24-hour periods before ``now``."""
    days = F.greatest(F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000), F.lit(0))
    out = F.when(ts.isNull(), UNREADABLE)
    for limit, weight in AGE_WEIGHTS:
        out = out.when(days <= limit, weight)
    return out.otherwise(OLDER)


def weight_sql(now: str) -> str:
    days = f"greatest(floor((epoch_us(TIMESTAMP '{now}') - epoch_us(ts)) / 86400000000), 0)"
    return f"CASE WHEN ts IS NULL THEN 0.7::DOUBLE WHEN {days} <= 7 THEN 1.0::DOUBLE WHEN {days} <= 30 THEN 0.85::DOUBLE WHEN {days} <= 90 THEN 0.65::DOUBLE ELSE 0.45::DOUBLE END"


def weighted(feedback: DataFrame, key: list[str], now: str) -> DataFrame:
    """Counts and weighted sums of ratings for each key; weights are summed as decimals, so order does not matter."""
    w = age_weight(F.col("ts"), now).cast("decimal(12,2)")
    side = lambda r: F.sum(F.when(F.col("rating") == r, w).otherwise(0)).cast("double")
    return feedback.groupBy(*key).agg(F.count("*").alias("n"), F.sum(w).cast("double").alias("w"), side("positive").alias("pos"), side("negative").alias("neg"), F.max("ts").alias("latest"))


def weighted_sql(key: str, now: str) -> str:
    w = f"CAST({weight_sql(now)} AS DECIMAL(12,2))"
    return f"SELECT {key}, count(*) AS n, CAST(sum({w}) AS DOUBLE) AS w, CAST(sum(CASE WHEN rating = 'positive' THEN {w} ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN rating = 'negative' THEN {w} ELSE 0 END) AS DOUBLE) AS neg, max(ts) AS latest FROM fb GROUP BY {key}"


def confidence(n: F.Column, w: F.Column) -> F.Column:
    """Grows with the sample, shrinks with its age; at least a quarter."""
    return F.round(F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.log(1.0 + n) / F.log(F.lit(13.0))) * F.least(F.lit(1.0), w / n)), 2)


CONFIDENCE_SQL = "round(greatest(0.25::DOUBLE, least(1.0::DOUBLE, ln(1.0 + n) / ln(13.0::DOUBLE)) * least(1.0::DOUBLE, w / n)), 2)"


def model_rules(by_model: DataFrame) -> DataFrame:
    """Score shift of each model with at least three events and a clear balance; zero shifts are no rules."""
    net = (F.col("pos") - F.col("neg")) / F.greatest(F.col("w"), F.lit(0.1))
    c = confidence(F.col("n"), F.col("w"))
    shift = F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), net * 8 * c)), 1)
    return by_model.where("n >= 3").withColumn("net", net).where("abs(net) >= 0.2").select("model", shift.alias("delta"), c.alias("confidence")).where("delta <> 0")
