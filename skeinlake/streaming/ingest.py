"""Capture and page rows as streams: the bounded operators' counterparts with explicit state limits.

The archive formats are bounded files, so these are for feeds of index or page rows that arrive
late and repeatedly. Watermarks bound the state; what comes later than that is dropped by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.urls import surt_wayback


def distinct_captures(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """First arrival of each index line (package, index, key, time, digest) within the watermark of ``seen_at``."""
    keyed = stream.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", late)
    return keyed.dropDuplicatesWithinWatermark(["package_id", "index_path", "key", "ts_raw", "digest"])


def captures_per_window(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, package_id, n) in event-time windows of ``seen_at``; a window is final when the watermark passes it."""
    keyed = stream.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", late)
    return keyed.groupBy(F.window("seen_at", window), "package_id").agg(F.count(F.lit(1)).alias("n"))


def annotated_pages(drafts: DataFrame, annotations: DataFrame, wait: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Page drafts (record_id, url, at) with annotations (record_id, title, at) that come within ``wait`` of them, before or after."""
    d = drafts.withWatermark("at", late).alias("d")
    a = annotations.withColumnRenamed("at", "noted_at").withWatermark("noted_at", late).alias("a")
    near = (F.col("d.record_id") == F.col("a.record_id")) & (F.col("noted_at") >= F.col("at") - F.expr(f"interval {wait}")) & (F.col("noted_at") <= F.col("at") + F.expr(f"interval {wait}"))
    return d.join(a, near, "left").select("d.record_id", "d.url", surt_wayback(F.col("d.url")).alias("key"), "a.title", "at")
