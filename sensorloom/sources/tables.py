"""Typed views of the star-schema tables as sensor data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = 43_200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, pid, t, x, tag): events as samples of a participant; t in epoch seconds, tag marks button presses."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6D")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pid"), t.alias("t"), F.col("value").alias("x"), (F.col("event_type") == "error").alias("tag"))
