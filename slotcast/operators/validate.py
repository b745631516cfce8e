"""Checks of forecast panels: a table of violations, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .panel import differences
from .profile import SLOTS


def grid_violations(panel: DataFrame, expected: DataFrame, skip: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, model, ts, kind): slots that a model misses or has too many.

    ``expected`` has ts; ``skip`` has dates that no model must have.
    ``by`` names further keys of ``panel``, such as the series.
    """
    if skip is not None:
        expected = expected.join(skip.select(F.col("date").alias("_d")), F.to_date("ts") == F.col("_d"), "left_anti")
    models = panel.select(*by, "model").distinct()
    return differences(models.join(expected.select("ts"), how="cross"), panel, [*by, "model", "ts"])


def whole_days(panel: DataFrame) -> DataFrame:
    """Models whose number of rows is no multiple of a day's slots."""
    return panel.groupBy("model").agg(F.count("*").alias("n")).where(F.col("n") % SLOTS != 0)


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_missing) of columns with NULL or NaN."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    counts = df.agg(*[F.count_if(gone(c)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_missing").where("n_missing > 0")


def non_numeric(df: DataFrame, keys: tuple[str, ...] = ("model", "ts")) -> list[str]:
    """Columns that are no numbers, read from the schema."""
    return [f.name for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, T.NumericType)]


def monotonicity_violations(rows: DataFrame, keys: list[str], q: str = "q", tolerance: float = 1e-12) -> DataFrame:
    """By key: the number of rows with falling quantiles, and the first of them."""
    from ..functions.columns import crosses

    bad = rows.where(crosses(q, tolerance))
    return bad.groupBy(*keys).agg(F.count("*").alias("n_bad"), F.min("ts").alias("first_ts"))


def require_none(violations: DataFrame, what: str) -> None:
    """Raises with the first violations if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
