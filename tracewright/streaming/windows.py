"""Streaming extension over event tables: late rows are dropped past the watermark. The same code runs on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = events.withColumn("at", F.col("ts").cast("timestamp"))
    out = out.withWatermark("at", late) if out.isStreaming else out
    return out.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withColumn("at", F.col("ts").cast("timestamp"))
    out = out.withWatermark("at", late) if out.isStreaming else out
    return out.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
