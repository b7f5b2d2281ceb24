"""An extension of our own: windowed counts over an event stream, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """(window_start, kind, n, total) of a stream or table; rows later than `late` behind the newest are not counted in a stream."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")
