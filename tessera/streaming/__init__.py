"""Windowed counts over an event stream, the same for batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum of ``value`` for each window and key.

    On a stream, state older than the watermark ``late`` is dropped, and so are
    rows that arrive after it; a batch has no watermark.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "total")
