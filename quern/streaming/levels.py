"""Levels of a stream of samples by event time: what ``signals.frame_rms`` does for stored signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rms(samples: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``key, start, n, rms, peak`` of rows ``key, ts, value`` in tumbling windows; works on batches and streams alike."""
    rows = samples.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    w = rows.withWatermark("ts", late).groupBy("key", F.window("ts", width))
    return w.agg(F.count("value").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak")).select("key", F.col("window.start").alias("start"), "n", "rms", "peak")
