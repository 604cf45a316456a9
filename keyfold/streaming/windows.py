"""Grouped reducers over streams: the free and bound variables of a query become window, key and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REDUCERS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def windowed_group(events: DataFrame, time: str, width: str, keys: list[str], reducers: dict[str, tuple[str, str]], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """One row per window and key; ``reducers`` maps a name to (sum, count, min, max or avg, column). Rows later than ``late`` are left
    out by the watermark, which also bounds the state. The same call works on a batch table."""
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    frame = events.withWatermark(time, late) if events.isStreaming else events
    aggregates = [_REDUCERS[op](column).alias(name) for name, (op, column) in reducers.items()]
    grouped = frame.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *reducers)
