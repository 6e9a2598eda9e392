"""Event windows. Each works on a batch and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str) -> DataFrame:
    g = events.groupBy(F.window("ts", size).alias("w"), "event_type")
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    return g.agg(F.count("*").alias("n"), users.alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_of_each(events: DataFrame) -> DataFrame:
    """The first event of each user and type."""
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))
