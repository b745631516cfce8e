"""Named queries with, where SQL can say it, the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def also(suffix: str, *names: str) -> None:
    """Keeps further names of queries, from when the plain names stood for a part of the work."""
    for name in names:
        QUERIES[f"{name}_{suffix}"], SQL[f"{name}_{suffix}"] = QUERIES[name], SQL[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits: sums in another order differ beyond."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def when(ts: str = "ts", name: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm").alias(name)


def day(date: str = "date") -> Column:
    return F.col(date).cast("string").alias(date)


def steady(c: Column, name: str, digits: int = 4) -> Column:
    """Rounded after a shift far below the last digit, so exact halves (of sums of decimals) round one way in every engine."""
    return (F.round(c + 10.0 ** -(digits + 3), digits) + 0.0).alias(name)
