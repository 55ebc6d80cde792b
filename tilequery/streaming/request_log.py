"""Streaming extension: a request log with equal requests collapsed and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["slide_id", "level", "tile_x", "tile_y", "quality"]


def collapsed(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """log (ts, slide_id, level, tile_x, tile_y, quality): the first of equal requests within the delay."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEY)


def windowed(log: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests and slides by window; rows later than the delay are dropped by the watermark."""
    per = log.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "slide_id").agg(F.count("*").alias("requests"))
    return per.select(F.col("w.start").alias("start"), "slide_id", "requests")
