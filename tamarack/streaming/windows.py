"""Streaming extension: daily event windows with a watermark. The reference's own windows are count-based batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counts and totals by day and event type; with a watermark for a stream."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The same windows over a directory of Parquet files that grows."""
    return daily(spark.readStream.schema(schema).parquet(path), "2 days")
