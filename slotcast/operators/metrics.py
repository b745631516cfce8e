"""Errors of point forecasts and scores of quantile forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import covered, is_finite, pinball
from .panel import pivot_models


def point_metrics(panel: DataFrame, keys: list[str]) -> DataFrame:
    """mae, rmse, bias (prediction minus truth), n_obs and n_inf_nan by key, in one pass."""
    return panel.groupBy(*keys).agg(*_errors())


def _errors() -> list[Column]:
    good = is_finite("y_pred") & is_finite("y_true")
    e = F.when(good, F.col("y_pred") - F.col("y_true"))
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.count(e).alias("n_obs"), F.count_if(F.coalesce(~good, F.lit(True))).alias("n_inf_nan"),
    ]


def daily_skill(panel: DataFrame, models: list[str], reference: str, keys: list[str]) -> DataFrame:
    """(keys, date, model): metrics of a day, ``relative_mae`` to the reference model's day, ``n_common`` slots that all models forecast.

    Read from a panel that :func:`~slotcast.sources.shared.stored_by` keeps in buckets of (date, keys),
    every sum, the models side by side and their join stay in the buckets.  The relative
    error is NULL where the reference has none, or none but 0; ``n_common`` is NULL where a key is.
    """
    day = ["date", *keys]
    scores = point_metrics(panel, [*day, "model"])
    wide = pivot_models(panel, models, [*day, "mtu"])
    common = wide.groupBy(*day).agg(F.count_if(F.coalesce(reduce(lambda a, b: a & b, [is_finite(m) for m in models]), F.lit(False))).alias("n_common"))
    own = F.max(F.when(F.col("model") == reference, F.col("mae"))).over(Window.partitionBy(*day))
    return scores.join(common, day, "left").withColumn("relative_mae", F.col("mae") / F.nullif(own, F.lit(0.0)))


def metrics_by_period(panel: DataFrame, keys: list[str], period: str) -> DataFrame:
    """One row ``full`` and one for each period, by grouping sets."""
    rows = panel.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in [*keys, period]]], *keys, period)
    out = rows.agg(F.grouping(period).alias("_g"), *_errors())
    return out.withColumn("period", F.when(F.col("_g") == 1, "full").otherwise(F.col(period).cast("string"))).drop("_g", period)


def daily_scores(rows: DataFrame, inner: tuple[float, float] = (0.25, 0.75), outer: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """Scores of each (model, date), and the mean of the days as row ``mean``.

    ``rows`` is long: model, date, ts, tau, q, y_true.  Days weigh the same whatever
    their number of slots.
    """
    at = lambda tau: F.max(F.when(F.col("tau") == tau, F.col("q")))
    slots = rows.groupBy("model", "date", "ts").agg(
        F.first("y_true").alias("y"), at(0.5).alias("q50"), at(inner[0]).alias("i0"), at(inner[1]).alias("i1"), at(outer[0]).alias("o0"), at(outer[1]).alias("o1"),
        F.avg(pinball("y_true", "q", "tau")).alias("aps"),
    )
    return _by_day(slots)


def daily_scores_of_arrays(rows: DataFrame, taus: list[float], inner: tuple[float, float] = (0.25, 0.75), outer: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """The same where the quantiles of a row lie in an array ``q`` in the order of ``taus``: rows meet only in the sums by day."""
    at = lambda tau: F.element_at("q", taus.index(tau) + 1)
    slots = rows.select(
        "model", "date", F.col("y_true").alias("y"), at(0.5).alias("q50"), at(inner[0]).alias("i0"), at(inner[1]).alias("i1"), at(outer[0]).alias("o0"), at(outer[1]).alias("o1"),
        mean_pinball("y_true", "q", taus).alias("aps"),
    )
    return _by_day(slots)


def mean_pinball(y: str, q: str, taus: list[float]) -> Column:
    """Mean pinball loss over the levels of an array of quantiles; levels without quantile are left out."""
    losses = [pinball(F.col(y), F.element_at(q, i + 1), tau) for i, tau in enumerate(taus)]
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in losses])
    return F.when(n > 0, reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in losses]) / n)


def _by_day(slots: DataFrame) -> DataFrame:
    scores = [
        F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae_median"), F.avg(covered("y", "i0", "i1")).alias("coverage_inner"),
        F.avg(covered("y", "o0", "o1")).alias("coverage_outer"), F.avg("aps").alias("aps"),
    ]
    days = slots.groupBy("model", F.col("date").cast("string").alias("period")).agg(*scores)
    mean = days.groupBy("model").agg(F.lit("mean").alias("period"), *[F.avg(c).alias(c) for c in ("mae_median", "coverage_inner", "coverage_outer", "aps")])
    return days.unionByName(mean)


def aps_by_slot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pinball loss over the quantile levels of each key."""
    return rows.groupBy(*keys).agg(F.avg(pinball("y_true", "q", "tau")).alias("aps"))


def coverage_table(panel: DataFrame, intervals: list[tuple[str, float, float]]) -> DataFrame:
    """(model, interval, nominal, n, coverage).

    ``panel`` is long (model, ts, tau, q, y_true); ``intervals`` are (name, lower level,
    upper level).  Both ends of all intervals are gathered in one pass; a slot that
    lacks an end of an interval is no slot of it.
    """
    at = lambda tau: F.max(F.when(F.col("tau") == tau, F.col("q")))
    ends = [F.struct(F.lit(name).alias("interval"), F.lit(hi - lo).alias("nominal"), at(lo).alias("low"), at(hi).alias("high")) for name, lo, hi in intervals]
    slots = panel.groupBy("model", "ts").agg(F.first("y_true").alias("y"), F.array(*ends).alias("ends"))
    return _coverage(slots)


def coverage_of_arrays(rows: DataFrame, taus: list[float], intervals: list[tuple[str, float, float]]) -> DataFrame:
    """The same where the quantiles of a row lie in an array ``q`` in the order of ``taus``."""
    at = lambda tau: F.element_at("q", taus.index(tau) + 1)
    ends = [F.struct(F.lit(name).alias("interval"), F.lit(hi - lo).alias("nominal"), at(lo).alias("low"), at(hi).alias("high")) for name, lo, hi in intervals]
    return _coverage(rows.select("model", F.col("y_true").alias("y"), F.array(*ends).alias("ends")))


def _coverage(slots: DataFrame) -> DataFrame:
    each = slots.select("model", "y", F.inline("ends")).where("low is not null and high is not null")
    return each.groupBy("model", "interval").agg(F.max("nominal").alias("nominal"), F.count("*").alias("n"), F.avg(covered("y", "low", "high")).alias("coverage"))


def crossing_counts(rows: DataFrame, keys: list[str], q: str = "q") -> DataFrame:
    """Rows whose quantiles cross, by key."""
    from ..functions.columns import crosses

    return rows.groupBy(*keys).agg(F.count_if(crosses(q)).alias("n_crossing"), F.count("*").alias("n_rows"))


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: NULLs, smallest, largest and number of distinct values."""
    facts = [
        F.struct(
            F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.min(F.col(c).cast("double")).alias("low"),
            F.max(F.col(c).cast("double")).alias("high"), F.count_distinct(c).alias("n_distinct"),
        )
        for c in columns
    ]
    return df.agg(*[f.alias(f"f{i}") for i, f in enumerate(facts)]).select(F.explode(F.array(*[f"f{i}" for i in range(len(facts))])).alias("f")).select("f.*")


def runtime_summary(runs: DataFrame, keys: list[str], seconds: str = "runtime_seconds") -> DataFrame:
    """Mean, shortest and longest run in minutes."""
    m = F.col(seconds) / 60
    return runs.groupBy(*keys).agg(F.avg(m).alias("mean_min"), F.min(m).alias("min_min"), F.max(m).alias("max_min"))
