"""Scales of training windows: robust, min-max, degeneracy; fold scaling.

Everything is grouped by (keys, feature); a fold's scales do not depend on the slot
that is forecast, so they are computed once for each forecast day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MAD_TO_SD, TINY, vst
from .panel import rolling_facts
from .selection import exact_quantiles
from .spatial import small

#: Families by their scaling in point models.
ROBUST_VST, ROBUST, MINMAX, PLAIN = ("price", "auction"), ("wind", "load"), ("ssrd", "sw_dir", "sw_dif", "other"), ("calendar",)
SOLAR = ("ssrd", "sw_dir", "sw_dif")


def _usable(scale: Column) -> Column:
    """A scale, or 1 where it is tiny or not finite."""
    return F.when((scale > TINY) & (scale < float("inf")), scale).otherwise(1.0)


def robust_params(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, center, scale): exact median, and MAD over the normal quantile (O69), of groups of any size.

    A scale that is tiny or not finite is 1.
    """
    centers = exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("center"))
    apart = df.join(small(centers), keys).withColumn("_apart", F.abs(F.col(value) - F.col("center")))
    spread = exact_quantiles(apart, [*keys, "center"], "_apart", [0.5])
    return spread.select(*keys, "center", _usable(F.col("q")[0] / MAD_TO_SD).alias("scale"))


def _middle(values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(values)
    return (values[F.floor((n - 1) / 2).cast("int")] + values[F.floor(n / 2).cast("int")]) / 2


def _with_scales(facts: DataFrame) -> DataFrame:
    """center and scale from the window's values in ``_values``."""
    sorted_ = facts.withColumn("_values", F.array_sort("_values")).withColumn("center", _middle(F.col("_values")))
    apart = F.array_sort(F.transform("_values", lambda v: F.abs(v - F.col("center"))))
    return sorted_.withColumn("scale", _usable(_middle(apart) / MAD_TO_SD))


def rolling_robust_params(days: DataFrame, history: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(day, keys, center, scale) of the n days before each day (O69); a window's values are one array."""
    rows = history.where("value is not null")
    facts = rolling_facts(days, rows.select(*keys, "date", "value"), n, keys, {"_values": F.collect_list("value")})
    return _with_scales(facts).select("day", *keys, "center", "scale")


def minmax_params(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, low, range) of the training rows."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), (F.max(value) - F.min(value)).alias("range"))


def minmax(value: Column, low: Column, span: Column, constant: float | None = 0.0) -> Column:
    """Scaled value; where the range is tiny ``constant``, or with None the plain shift."""
    flat = value - low if constant is None else F.lit(constant)
    usable = (span > TINY) & (span < float("inf"))
    return F.when(usable, (value - low) / span).otherwise(flat)


def degenerate(df: DataFrame, keys: list[str], value: str = "value", least_range: float = 20.0, least_share: float = 0.5, least_iqr: float | None = None) -> DataFrame:
    """(keys, degenerate): range or share of positive values too small, or IQR."""
    span = F.max(value) - F.min(value)
    share = F.avg((F.col(value) > 0).cast("double"))
    out = df.groupBy(*keys).agg(((span < least_range) | (share < least_share)).alias("degenerate"))
    if least_iqr is None:
        return out
    quartiles = exact_quantiles(df, keys, value, [0.25, 0.75]).select(*keys, ((F.col("q")[1] - F.col("q")[0]) < least_iqr).alias("_narrow"))
    return out.join(quartiles, keys, "left").withColumn("degenerate", F.col("degenerate") | F.col("_narrow")).drop("_narrow")


def fold_params(days: DataFrame, features: DataFrame, n: int, least_range: float = 20.0, least_share: float = 0.5) -> DataFrame:
    """Every scale of the folds of n days before each day, by (day, family, feature), in one pass.

    ``features`` is long: date, family, feature, value.  Rows are not dealt to the days
    that see them: a fold's values come together as one array over a moving frame.
    """
    keys = ["family", "feature"]
    v = F.col("value")
    facts = {
        "low": F.min("value"), "high": F.max("value"), "positive": F.avg((v > 0).cast("double")), "_values": F.collect_list("value"),
    }
    out = _with_scales(rolling_facts(days, features.select(*keys, "date", "value"), n, keys, facts)).withColumn("range", F.col("high") - F.col("low"))
    solar = F.col("family").isin(*SOLAR) & ((F.col("range") < least_range) | (F.col("positive") < least_share))
    return out.select("day", *keys, "center", "low", "range", "scale", F.coalesce(solar, F.lit(False)).alias("degenerate"))


def scale_fold(rows: DataFrame, params: DataFrame, keys: list[str], use_vst: bool = True) -> DataFrame:
    """``rows`` (train or test) with ``value`` scaled by family for point models."""
    joined = rows.join(params, [*keys, "family", "feature"])
    robust = (F.col("value") - F.col("center")) / F.col("scale")
    scaled = (
        F.when(F.col("degenerate"), 0.0)
        .when(F.col("family").isin(*ROBUST_VST), vst(robust) if use_vst else robust)
        .when(F.col("family").isin(*ROBUST), robust)
        .when(F.col("family").isin(*PLAIN), F.col("value"))
        .otherwise(minmax(F.col("value"), F.col("low"), F.col("range"), None))
    )
    return joined.withColumn("value", scaled).drop("center", "scale", "low", "range", "degenerate")


def scale_fold_anc(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`scale_fold` with min-max for all but calendar features."""
    joined = rows.join(params, [*keys, "family", "feature"])
    scaled = F.when(F.col("degenerate"), 0.0).when(F.col("family").isin(*PLAIN), F.col("value"))
    scaled = scaled.otherwise(minmax(F.col("value"), F.col("low"), F.col("range"), 0.0))
    return joined.withColumn("value", scaled).drop("center", "scale", "low", "range", "degenerate")
