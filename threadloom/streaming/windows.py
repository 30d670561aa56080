"""Event-time windows and bursts of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, end, key, n, value): tumbling or sliding windows; rows later than ``delay`` are dropped, as watermarks do."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, delay).groupBy(window.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "value")


def debounced(
    changes: DataFrame, time: str, path: str, quiet: str = "500 milliseconds", delay: str = "0 seconds", root: str | None = None
) -> DataFrame:
    """(root, start, end, paths, n): bursts of file changes that end after a quiet period, each path once, in order.

    ``root`` names the column of what is watched; without it all changes form one burst together.
    """
    key = F.col(root) if root else F.lit("")
    rows = changes.withColumn("_root", key).withWatermark(time, delay).groupBy(F.session_window(time, quiet).alias("w"), "_root").agg(
        F.array_sort(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("n")
    )
    return rows.select(F.col("_root").alias("root"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def deduplicated(events: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Events of which repeats arrive within a time; the first delivery stays."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
