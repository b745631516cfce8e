"""Slot means over a stream: what the batch operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_means(stream: DataFrame, series: str, late: str = "1 hour", ts: str = "ts", value: str = "value") -> DataFrame:
    """(series, ts, value): mean of each closed quarter hour; later rows are dropped."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, "15 minutes"), F.col(series).alias("series"))
    return rows.agg(F.avg(value).alias("value")).select("series", F.col("window.start").alias("ts"), "value")
