"""Extension: the query log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of each key in tumbling windows; rows later than `late` behind the newest are dropped by the watermark. Works on batches too."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
