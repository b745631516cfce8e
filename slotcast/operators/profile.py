"""Daily profiles: one value for each date, series and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 96


def daily_profile(df: DataFrame, keys: list[str], slot: str = "mtu", date: str = "date", value: str = "value") -> DataFrame:
    """Mean value by date, key and slot; the autumn hour that comes twice is averaged."""
    return df.groupBy(date, *keys, slot).agg(F.avg(value).alias(value))


def wide_profile(profile: DataFrame, keys: list[str], prefix: str, slots: int = SLOTS, slot: str = "mtu", value: str = "value") -> DataFrame:
    """One row for each date and key, a column for each slot, named ``{prefix}_{slot}_{nn}``.

    An output view; the operators work on the long form.
    """
    wide = profile.groupBy("date", *keys).pivot(slot, list(range(slots))).agg(F.first(value))
    return wide.withColumnsRenamed({str(k): f"{prefix}_{slot}_{k:02d}" for k in range(slots)})


def slot_skeleton(profile: DataFrame, keys: list[str], slots: int = SLOTS, slot: str = "mtu") -> DataFrame:
    """Every slot of each date and key, NULL where there is no value."""
    days = profile.select("date", *keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return days.join(profile, ["date", *keys, slot], "left")


def interpolate(skeleton: DataFrame, keys: list[str], limit: int = 4, slot: str = "mtu", value: str = "value") -> DataFrame:
    """Linear between valid slots; only the first ``limit`` slots of a gap are filled.

    Each (date, key) is by itself, so no gap is filled from another series.
    """
    day = Window.partitionBy("date", *keys).orderBy(slot)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(slot).alias("s"), F.col(value).alias("v")))
    rows = skeleton.withColumn("_p", F.last(here, True).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.first(here, True).over(day.rowsBetween(0, Window.unboundedFollowing)))
    p, n = F.col("_p"), F.col("_n")
    share = (F.col(slot) - p["s"]) / (n["s"] - p["s"])
    filled = F.when((F.col(slot) - p["s"] <= limit) & n["s"].isNotNull(), p["v"] + (n["v"] - p["v"]) * share)
    return rows.withColumn(value, F.coalesce(value, filled)).drop("_p", "_n")


def day_lag(profile: DataFrame, keys: list[str], lags: list[int], calendar: bool = False, slot: str = "mtu", value: str = "value") -> DataFrame:
    """Adds ``lag_{n}`` columns: the slot's value n days before.

    By position among the days that exist, or (``calendar``) by date.
    """
    if not calendar:
        order = Window.partitionBy(*keys, slot).orderBy("date")
        return profile.withColumns({f"lag_{n}": F.lag(value, n).over(order) for n in lags})
    for n in lags:
        earlier = profile.select(F.date_add("date", n).alias("date"), *keys, slot, F.col(value).alias(f"lag_{n}"))
        profile = profile.join(earlier, ["date", *keys, slot], "left")
    return profile


def time_lag(df: DataFrame, keys: list[str], days: list[int], ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``lag_{n}d`` columns: the value exactly n times 24 hours before."""
    for n in days:
        earlier = df.select(*keys, (F.col(ts) + F.make_dt_interval(F.lit(n))).alias(ts), F.col(value).alias(f"lag_{n}d"))
        df = df.join(earlier, [*keys, ts], "left")
    return df


def step_changes(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Adds ``diff``, the change from the row before within each key."""
    return df.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
