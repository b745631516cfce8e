"""Feature blocks: complete cases, assembly and calendar rows in long form.

Long features are (date, family, feature, slot, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_holiday, regime_flag, weekday_flags

FAMILIES = ["price", "auction", "load", "wind", "ssrd", "sw_dir", "sw_dif", "calendar"]


def feature_count(clusters: int, source: str, enriched: bool = False) -> int:
    """Number of features of a configuration."""
    weather = {"era5": 48, "icon": 24 + 2 * 96}[source] * clusters
    return weather + 3 * 96 + 96 + 9 + (96 if enriched else 0)


def calendar_features(days: DataFrame, regime_since: str = "2025-10-01", date: str = "date") -> DataFrame:
    """date with the regime flag, weekday flags and holiday flag."""
    return days.select(date, regime_flag(F.col(date), regime_since).alias("is_15min_market"), *weekday_flags(date), is_holiday(date).alias("is_holiday"))



def as_long(wide: DataFrame, family: str, date: str = "date") -> DataFrame:
    """A wide block of features as long rows."""
    names = [c for c in wide.columns if c != date]
    rows = wide.select(date, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(date, names, "feature", "value")
    return rows.select(date, F.lit(family).alias("family"), "feature", F.lit(0).alias("slot"), "value")



def assemble(blocks: list[DataFrame]) -> DataFrame:
    """All blocks, on the days that every block has."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("_block", F.lit(i)) for i, b in enumerate(blocks)])
    days = rows.groupBy("date").agg(F.count_distinct("_block").alias("n")).where(F.col("n") == len(blocks)).select("date")
    return rows.drop("_block").join(days, "date", "left_semi")


def incomplete_days(features: DataFrame) -> DataFrame:
    """(date, null_features): days with a NULL feature and which."""
    names = F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("feature"))))
    return features.groupBy("date").agg(names.alias("null_features")).where(F.size("null_features") > 0)


def complete_cases(features: DataFrame) -> DataFrame:
    """The rows of days without NULL."""
    bad = features.where("value is null").select("date").distinct()
    return features.join(bad, "date", "left_anti")
