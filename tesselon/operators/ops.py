"""Metrics, rate limits, sessions and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics_summary(events: DataFrame, *keys: str) -> DataFrame:
    n = F.count("*")
    return events.groupBy(*keys).agg(n.cast("long").alias("total"), F.round(F.avg("value"), 6).alias("avg_latency"), F.round(F.sum((F.col("event_type") == "error").cast("int")) / F.greatest(n, F.lit(1)), 6).alias("error_rate"), F.count_distinct("user_id").cast("long").alias("users"))


def rate_limited(events: DataFrame, seconds: int, most: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w).cast("long")).withColumn("limited", F.col("recent") > most)


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_events"))


def version_numbers(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int"))
