"""Tests of predictive accuracy and of coverage, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CHI2_1_95, erfc, TINY


def losses(panel: DataFrame, norm: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, model, date, mtu, loss): absolute or squared errors."""
    e = F.col("y_pred") - F.col("y_true")
    return panel.select(*keys, "model", "date", "mtu", (F.abs(e) if norm == 1 else e * e).alias("loss"))


def loss_differences(loss: DataFrame, by_slot: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, model_a, model_b, date[, mtu], d): loss of a minus loss of b.

    Losses are computed once and joined with themselves by date and slot; each day's
    mean over the slots is the multivariate form.  ``by`` names further keys, such as the series.
    """
    keys = [*by, "date", "mtu"] if by_slot else [*by, "date"]
    rows = loss if by_slot else loss.groupBy(*by, "model", "date").agg(F.avg("loss").alias("loss"))
    a = rows.select(*keys, F.col("model").alias("model_a"), F.col("loss").alias("loss_a"))
    b = rows.select(*keys, F.col("model").alias("model_b"), F.col("loss").alias("loss_b"))
    pairs = a.join(b, keys).where("model_a <> model_b")
    return pairs.select("model_a", "model_b", *keys, (F.col("loss_a") - F.col("loss_b")).alias("d"))


def giacomini_white(diff: DataFrame, by: list[str], sign_scope: str = "lagged") -> DataFrame:
    """Conditional predictive ability: statistic and p-value by pair (O82) or pair and slot.

    The regression of 1 on (d, d * d before) has its statistic in closed form from
    five sums.  Its sign is that of the mean of d, over the days with a day before
    (``lagged``) or over ``all``; a model that is not better has p = 1.  A singular
    matrix gives 0.
    """
    before = F.lag("d").over(Window.partitionBy(*by).orderBy("date"))
    rows = diff.withColumn("b", before)
    d, b = F.col("d"), F.col("b")
    held = F.when(b.isNotNull(), d)
    sums = rows.groupBy(*by).agg(
        F.sum(held).alias("s1"), F.sum(d * b).alias("s2"), F.sum(held * held).alias("m11"), F.sum(d * d * b).alias("m12"),
        F.sum(d * d * b * b).alias("m22"), F.count(b).alias("n"), F.avg(d if sign_scope == "all" else held).alias("mean_d"),
    )
    s1, s2, m11, m12, m22 = (F.col(c) for c in ("s1", "s2", "m11", "m12", "m22"))
    det = m11 * m22 - m12 * m12
    raw = F.when(F.abs(det) > TINY, (s1 * s1 * m22 - 2 * s1 * s2 * m12 + s2 * s2 * m11) / det).otherwise(0.0)
    stat = F.signum("mean_d") * raw
    return sums.select(*by, "n", stat.alias("statistic")).withColumn("p_value", F.when(F.col("statistic") > 0, F.exp(-F.col("statistic") / 2)).otherwise(1.0))


def p_value_matrix(tests: DataFrame, models: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Square table of p-values with 1 on the diagonal, for each ``by``."""
    same = tests.sparkSession.createDataFrame([(m, m, 1.0) for m in models], "model_a string, model_b string, p_value double")
    if by:
        same = same.join(tests.select(*by).distinct(), how="cross")
    return tests.select(*by, "model_a", "model_b", "p_value").unionByName(same).groupBy(*by, "model_a").pivot("model_b", models).agg(F.first("p_value"))


def kupiec(hits: DataFrame, by: list[str], nominal: Column) -> DataFrame:
    """Unconditional coverage: n, k, likelihood ratio, passed (5 %) by key.

    ``hits`` has ``hit`` (1 inside, 0 outside).  Where all or no values are inside the
    test fails.
    """
    sums = hits.groupBy(*by).agg(F.count("hit").alias("n"), F.sum("hit").alias("k"), F.first(nominal).alias("nominal")).where("n > 0")
    share = F.col("k") / F.col("n")
    lr = -2 * ((F.col("n") - F.col("k")) * F.log((1 - F.col("nominal")) / (1 - share)) + F.col("k") * F.log(F.col("nominal") / share))
    edge = (F.col("k") == 0) | (F.col("k") == F.col("n"))
    out = sums.withColumn("lr", F.when(~edge, lr))
    return out.withColumn("passed", F.coalesce(F.col("lr") <= CHI2_1_95, F.lit(False)))


def with_p_value(tests: DataFrame) -> DataFrame:
    """Adds ``p_value`` of the likelihood ratio: the tail of a squared normal variable; 0 where it is NULL."""
    tail = erfc(F.sqrt(F.greatest(F.col("lr"), F.lit(0.0)) / 2))  # rounding may leave a ratio just below 0
    return tests.withColumn("p_value", F.when(F.col("lr").isNull(), 0.0).otherwise(tail))


def passed_slots(tests: DataFrame, by: list[str]) -> DataFrame:
    """How many slots pass."""
    return tests.groupBy(*by).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_slots"))
