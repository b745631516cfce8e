"""Regular time grids, bounded fills, day keys and time windows.

Local days follow the session time zone (TIMESTAMP) or none (TIMESTAMP_NTZ); a local
day has 92, 96 or 100 quarter-hour slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import slot_of


def with_keys(df: DataFrame, ts: str = "ts", one_based: bool = False) -> DataFrame:
    """Adds the local date, hour and slot."""
    return df.withColumns({"date": F.to_date(ts), "hour": F.hour(ts), "mtu": slot_of(ts, one_based)})


def floor_slot(ts: str = "ts", minutes: int = 15) -> Column:
    """The start of the slot of ``minutes`` that holds a time without zone."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60
    start = second - second % (minutes * 60)
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), start)


def slot_means(df: DataFrame, series: str, value: str = "value", ts: str = "ts", minutes: int = 15) -> DataFrame:
    """(series, ts, value): the mean of each slot."""
    rows = df.select(F.col(series).alias("series"), floor_slot(ts, minutes).alias("ts"), F.col(value).alias("value"))
    return rows.groupBy("series", "ts").agg(F.avg("value").alias("value"))


def regular_grid(df: DataFrame, keys: list[str], ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Every slot from the first to the last local day of each key."""
    kind = dict(df.dtypes)[ts]
    spans = df.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("a"), F.date_add(F.to_date(F.max(ts)), 1).alias("b"))
    step = F.expr(f"interval {minutes} minutes")
    slots = F.sequence(F.col("a").cast(kind), F.col("b").cast(kind) - step, step)
    return spans.select(*keys, F.explode(slots).alias(ts))


def fill_forward(df: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", steps: int = 3, minutes: int = 15) -> DataFrame:
    """The last value of at most ``steps`` slots before each slot.

    Each value is dealt to the slots it may fill and the nearest wins, so the work is
    a hash aggregate by (key, slot) and no series is sorted in one task.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    moved = rows.withColumn(ts, F.col(ts) + F.col("_k") * F.expr(f"interval {minutes} minutes"))
    return moved.groupBy(*keys, ts).agg(F.min_by(value, "_k").alias(value))


def align(df: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", steps: int = 3, minutes: int = 15) -> DataFrame:
    """The series on its regular grid with a bounded forward fill."""
    grid = regular_grid(df, keys, ts, minutes)
    return grid.join(fill_forward(df, keys, value, ts, steps, minutes), [*keys, ts], "left")


def drop_incomplete_days(grid: DataFrame, keys: list[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Sets every value of a day to NULL if the day has fewer values than slots."""
    day = Window.partitionBy(*keys, F.to_date(ts))
    whole = F.count(value).over(day) == F.count(F.lit(1)).over(day)
    return grid.withColumn("_whole", whole).withColumn(value, F.when(F.col("_whole"), F.col(value))).drop("_whole")


def complete_days(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Every day between the first and the last of each key, new ones with NULLs."""
    spans = df.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*keys, date], "left")


def align_days(df: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """Exactly the days of ``days``, NULL where ``df`` has none."""
    return days.select(date).distinct().join(df, date, "left")


def shift(df: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Moves the labels, as from interval ends to starts."""
    return df.withColumn(ts, F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def local_day(df: DataFrame, date: Column, ts: str = "ts") -> DataFrame:
    """The rows of one local day, cut by the calendar, not by 24 hours."""
    return df.where(F.to_date(ts) == date)


def localise(df: DataFrame, ts: str = "ts", source: str = "UTC") -> DataFrame:
    """A time without zone, meant in ``source``, as an instant."""
    return df.withColumn(ts, F.expr(f"cast(convert_timezone('{source}', current_timezone(), {ts}) as timestamp)"))


def wall_clock(df: DataFrame, ts: str = "ts", zone: str = "Europe/Berlin") -> DataFrame:
    """An instant as the local time of ``zone``, without zone (O33); of the hour that comes twice both stay."""
    return df.withColumn(ts, F.expr(f"convert_timezone(current_timezone(), '{zone}', cast(cast({ts} as timestamp) as timestamp_ntz))"))


def time_slice(df: DataFrame, start: str, end: str, ts: str = "ts", skip: DataFrame | None = None) -> DataFrame:
    """Rows from ``start`` to ``end`` (both included) without the dates in ``skip.date``."""
    out = df.where(F.col(ts).between(F.lit(start), F.lit(end)))
    return out if skip is None else out.join(skip.select(F.col("date").alias("_d")), F.to_date(ts) == F.col("_d"), "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def day_list(spark, start: str, end: str) -> DataFrame:
    """One row for each day from ``start`` to ``end``."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date"))


def days_back(ts: Column | str, n: int, absolute: bool = False) -> Column:
    """``n`` calendar days before, or n times 24 hours before (session zone times)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.unix_micros(c) - n * 86_400_000_000) if absolute else c - F.make_interval(days=F.lit(n))


def inferred_step(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, seconds): the most frequent step, the smaller one in a tie."""
    by = Window.partitionBy(*keys, F.to_date(ts)).orderBy(ts)
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(by), F.col(ts))
    counts = df.select(*keys, gap.alias("seconds")).where("seconds is not null").groupBy(*keys, "seconds").count()
    return counts.groupBy(*keys).agg(F.max_by("seconds", F.struct("count", -F.col("seconds"))).alias("seconds"))
