"""Windowed aggregates over streams, and over tables in the same words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(frame: DataFrame, time: str, width: str, aggregates: list[Column], *, keys: list[str] | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by fixed (or, with ``slide``, overlapping) windows of event time. ``late``: how long a stream waits for late rows."""
    rows = frame.withWatermark(time, late) if late and frame.isStreaming else frame
    window = F.window(time, width, slide) if slide else F.window(time, width)
    made = rows.groupBy(window.alias("_w"), *(keys or [])).agg(*aggregates)
    return made.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in made.columns if c != "_w"])


def sessions(frame: DataFrame, time: str, gap: str, aggregates: list[Column], *, keys: list[str], late: str | None = None) -> DataFrame:
    """Aggregates by sessions: rows of a key that follow one another within the gap."""
    rows = frame.withWatermark(time, late) if late and frame.isStreaming else frame
    made = rows.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggregates)
    return made.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in made.columns if c != "_w"])


def first_seen(frame: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key's rows once within the time that late rows are waited for."""
    if frame.isStreaming:
        return frame.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return frame.dropDuplicates([key])
