"""What the operators share: tables in the shared folder, and lower case of A-Z only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_folder, stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(col, UPPER, LOWER)


#: A list of keys is sent to every task only up to so many rows.
BROADCAST_ROWS = 2_000_000
#: A key is hot if it holds more than this part of all rows, so fewer than so many keys are.
HOT_SHARE = 1000


def beside(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, with the hint to broadcast it if it has at most ``most`` rows; else Spark chooses the join."""
    return F.broadcast(df) if df.count() <= most else df


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """Inner join with ``right``, one row for each key, whose column ``count`` says how many rows of ``left`` (``total`` rows) have it.

    The rows of hot keys stay where they are and meet the fewer than ``HOT_SHARE`` rows
    of ``right`` that belong to them; only the others are shuffled.
    """
    is_hot = F.col(count) * HOT_SHARE > total
    hot, cold = F.broadcast(right.where(is_hot).drop(count)), right.where(~is_hot).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key))
