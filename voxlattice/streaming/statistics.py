"""Running statistics of readings; the batch and the stream share the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running(readings: DataFrame, ts: str, value: str, key: str, every: str, late: str = "1 day") -> DataFrame:
    """(start, key, n, mean, std, min, max) per tumbling window; on a stream, rows later than `late` are dropped."""
    rows = readings.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    out = rows.groupBy(F.window(ts, every).alias("w"), F.col(key)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), key, "n", "mean", "std", "min", "max")
