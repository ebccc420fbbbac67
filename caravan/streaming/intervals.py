"""Interval classification on streams of appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.plans.flow import classify_intervals


def streaming_vehicle_flow(appearances: DataFrame, intervals: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by road, interval and window of event time of a stream(gid, timeofday_secs, ts); state goes when the watermark passes.

    Works on bounded tables alike, where the watermark has no effect.
    """
    rows = classify_intervals(appearances.withWatermark(time, late), intervals)
    return rows.groupBy(F.window(time, window), "gid", "interval_name").agg(F.count("*").alias("value")).select(F.col("window.start").alias("window_start"), "gid", "interval_name", "value")
