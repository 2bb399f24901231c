"""The operators on streams. All of them are functions of a row, so they work on
readStream as they are; this adds the one stateful form that a stream of
measurements needs, tumbling windows with a watermark (extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.functions.series import to_bin


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "event_type", value: str = "value", bins: int = 4096) -> DataFrame:
    """window_start, key, n, scale and the bin of the last value by scale, for each tumbling
    window. Events later than the watermark are dropped; null values don't count."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where(F.col(value).isNotNull())
    grouped = timed.groupBy(F.window(time, every), key).agg(F.count("*").alias("n"), (F.avg(F.abs(value)) + 1e-10).alias("scale"), F.max_by(value, time).alias("last"))
    return grouped.select(F.col("window.start").alias("window_start"), key, "n", "scale", to_bin(F.col("last") / F.col("scale"), bins).alias("last_bin"))
