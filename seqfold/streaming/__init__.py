"""Streams of events. The reference has none; these functions run the pair operators over an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_symbols(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", time: str = "ts", symbol: str = "event_type") -> DataFrame:
    """(start, symbol, n): events by tumbling window and symbol; rows later than the watermark are dropped. For batches and streams alike."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs an instant
    counted = timed.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "symbol", "n")
