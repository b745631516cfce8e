"""Panels of several models: joins, set operations and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last in ``order`` (O5); an aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def longest_series(df: DataFrame, series: str = "series") -> DataFrame:
    """The rows of the series with most rows, the first by name in a tie."""
    top = df.groupBy(series).count().orderBy(F.desc("count"), series).limit(1)
    return df.join(top.select(series), series, "left_semi")


def join_variables(df: DataFrame, time: str, names: list[str], how: str = "inner") -> DataFrame:
    """Long variables side by side by time: times that all (inner) or any (full) have."""
    wide = df.groupBy(time).pivot("var", names).agg(F.first("value"))
    if how == "full":
        return wide
    return wide.dropna(subset=names)


def pivot_models(panel: DataFrame, models: list[str], keys: list[str], value: str = "y_pred") -> DataFrame:
    """One column for each model, full outer by the keys, with the first truth found (O52), in one aggregate."""
    of_model = [F.first(F.when(F.col("model") == m, F.col(value)), ignorenulls=True).alias(m) for m in models]
    truth = F.min_by("y_true", F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))).alias("y_true")
    return panel.groupBy(*keys).agg(*of_model, truth)


def rolling_window(days: DataFrame, history: DataFrame, n: int, absolute: bool = False, date: str = "date") -> DataFrame:
    """Each forecast day (column ``day``) with the history of the n days before it.

    Each day is dealt to its n dates and hash-joined, so nothing is compared pairwise.
    ``absolute`` steps 24 hours through instants at local midnight: a window across a
    clock change then misses a day, as fixed hours do.
    """
    back = F.explode(F.sequence(F.lit(1), F.lit(n)))
    dealt = days.select("day", back.alias("_k"))
    if absolute:
        start = F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) - n * 86_400_000_000)
        dealt = dealt.withColumn("_d", F.date_sub("day", F.col("_k"))).where(F.col("_d").cast("timestamp") >= start)
        last = F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) - 86_400_000_000)
        dealt = dealt.where(F.col("_d").cast("timestamp") <= last).select("day", F.col("_d").alias(date))
    else:
        dealt = dealt.select("day", F.date_sub("day", F.col("_k")).alias(date))
    return dealt.join(history, date)


def rolling_facts(days: DataFrame, history: DataFrame, n: int, keys: list[str], facts: dict[str, Column], date: str = "date") -> DataFrame:
    """day, keys and ``facts`` (name to aggregate of ``history``) of the n days before each day, where there are any rows.

    The facts are taken over moving frames of each key's rows in the order of time, so no
    row is dealt to the days that see it.  A day is a row without values among them.
    """
    blank = [F.lit(None).cast(t).alias(c) for c, t in history.dtypes if c not in (*keys, date)]
    marks = history.select(*keys).distinct().join(days.select(F.col("day").alias(date)).distinct(), how="cross")  # the rows of the result
    rows = history.withColumn("_mark", F.lit(False)).unionByName(marks.select(*keys, date, *blank, F.lit(True).alias("_mark")))
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-n, -1)
    real = F.count_if(~F.col("_mark")).over(frame).alias("_n")
    out = rows.select(F.col(date).alias("day"), *keys, "_mark", real, *[f.over(frame).alias(name) for name, f in facts.items()])
    return out.where("_mark and _n > 0").drop("_mark", "_n")


def only(df: DataFrame, members: DataFrame, on: list[str], inside: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in ``members``."""
    return df.join(members.select(*on).distinct(), on, "left_semi" if inside else "left_anti")


def differences(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Keys that are missing from ``found``, and keys it has too many."""
    a, b = expected.select(*on).distinct(), found.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, on, "left_anti").withColumn("kind", F.lit("extra")))


def union_all(parts: list[DataFrame], missing: bool = False) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), parts)


def ranked(df: DataFrame, by: list, within: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Adds ``rank``; with ``top`` only the first rows.

    Without ``within`` the table is a list of scores, which is short.
    """
    order = Window.partitionBy(*within).orderBy(*by) if within else Window.orderBy(*by)
    out = df.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def model_view(wide: DataFrame, model: str, taus: list[float], keys: list[str]) -> DataFrame:
    """The quantile columns ``{model}_q%.3f`` of one model, as ``q%.3f``."""
    names = {f"{model}_q{t:.3f}": f"q{t:.3f}" for t in taus}
    missing = [c for c in names if c not in wide.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return wide.select(*keys, *[F.col(f"`{a}`").alias(b) for a, b in names.items()])
