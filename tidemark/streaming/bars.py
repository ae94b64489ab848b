"""Daily bars from an event stream; the same aggregate serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", tie: str = "event_id", lateness: str = "2 days") -> DataFrame:
    """Open, high, low, close and count by key and day. On a stream days close once the watermark passes them; later events are dropped."""
    rows = events.select(F.col(time).cast("timestamp").alias("_t"), F.col(key).alias("series_id"), F.col(value).alias("_v"), F.struct(F.col(time), F.col(tie)).alias("_k"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", lateness)
    bars = rows.groupBy("series_id", F.window("_t", "1 day").alias("_day")).agg(F.min_by("_v", "_k").alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", "_k").alias("close"), F.count("_v").alias("n"))
    return bars.select("series_id", F.to_date("_day.start").alias("date"), "open", "high", "low", "close", "n")
