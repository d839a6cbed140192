"""Windowed counts and sums of an event stream, late events allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, window: str, late: str, *keys: str, value: str) -> DataFrame:
    """``start, keys, n, total`` per tumbling window; works on static and streaming DataFrames."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    out = stamped.groupBy(F.window("_at", window), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")
