"""Smoothed quantile regressions of all groups and levels at once, by Newton steps on Spark.

The windows' rows lie in one table, a fit's state in another.  A step joins the two,
takes every gradient and Hessian sum of every fit in one aggregate, and solves the small
systems in column expressions; fits that have converged drop out, the others go on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MAD_TO_SD
from ..functions.estimators import smooth_quantiles
from ..sources.shared import stored

#: A fit has converged when no element of its mean gradient exceeds this; a step is halved down to ``SMALLEST``.
FLAT, SMALLEST = 1e-9, 1e-6
#: Steps that all fits take together.
STEPS = 8


def _dot(k: int, coef: Column) -> Column:
    """Product of a row's k numbers in columns z0, z1, ... and an array."""
    return reduce(lambda a, b: a + b, [F.col(f"z{i}") * coef[i] for i in range(k)])


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _sums(k: int, weight: Column, slope: Column) -> list[Column]:
    """Sums of weight z z' (m0_0, m0_1, ...), once for each pair, and of slope z (g0, g1, ...)."""
    z = [F.col(f"z{i}") for i in range(k)]
    return [F.sum(weight * z[i] * z[j]).alias(f"m{i}_{j}") for i, j in _pairs(k)] + [F.sum(slope * z[i]).alias(f"g{i}") for i in range(k)]


def _solved(k: int, ridge) -> Column:
    """Solution of the positive definite system of these sums, by elimination of one row after the other."""
    lines = []
    for i in range(k):
        left = [F.col(f"m{min(i, j)}_{max(i, j)}") + (ridge(F.col(f"m{i}_{i}")) if i == j else F.lit(0.0)) for j in range(k)]
        lines.append(F.array(*left, F.col(f"g{i}")))

    def clear(matrix: Column, j: Column) -> Column:
        pivot = matrix[j]
        return F.transform(matrix, lambda line, i: F.zip_with(line, pivot, lambda a, p: F.when(i == j, a / pivot[j]).otherwise(a - line[j] / pivot[j] * p)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array(*lines), clear), lambda line: line[k])


def _started(rows: DataFrame, by: list[str], k: int, taus: list[float], bandwidth: float | None) -> DataFrame:
    """by, n, tau, h and trial: the least squares fit, moved to the residuals' quantile."""
    least = rows.groupBy(*by).agg(F.count("*").alias("n"), *_sums(k, F.lit(1.0), F.col("y"))).select(*by, "n", _solved(k, lambda d: d * 1e-12 + 1e-300).alias("b"))
    rest = rows.join(least, by).select(*by, "n", "b", (F.col("y") - _dot(k, F.col("b"))).alias("r"))
    levels = F.percentile("r", F.array(*[F.lit(float(t)) for t in taus]))
    facts = rest.groupBy(*by, "n", "b").agg(F.percentile(F.abs("r"), 0.5).alias("spread"), levels.alias("shifts"))
    width = F.lit(float(bandwidth)) if bandwidth else F.greatest(F.lit(0.05), F.pow((k + F.log("n")) / F.col("n"), F.lit(0.4)))
    h = F.greatest(F.col("spread") / MAD_TO_SD, F.lit(1e-6)) * width
    each = F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in taus]).alias("tau"), F.col("shifts").alias("shift")))
    first = F.transform("b", lambda v, i: F.when(i == 0, v + F.col("l.shift")).otherwise(v))
    return facts.select(*by, "n", "b", h.alias("h"), each.alias("l")).select(*by, "n", "h", F.col("l.tau").alias("tau"), first.alias("trial"))


def _moved(state: DataFrame, rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """One evaluation at the trial points; one is taken if its gradient shrank, else its step is halved."""
    risen = 1 / (1 + F.exp((F.col("y") - _dot(k, F.col("trial"))) / F.col("h")))  # the kernel's distribution function
    at = rows.join(state.select(*by, "n", "h", "tau", "trial"), by).select(*by, "n", "h", "tau", *[f"z{i}" for i in range(k)], risen.alias("f"))
    f = F.col("f")
    total = at.groupBy(*by, "tau").agg(*_sums(k, f * (1 - f) / (F.col("h") * F.col("n")), (f - F.col("tau")) / F.col("n")))
    g = [F.col(f"g{i}") for i in range(k)]
    found = total.select(
        *by, "tau", F.sqrt(reduce(lambda a, b: a + b, [x * x for x in g])).alias("_size"), F.greatest(*[F.abs(x) for x in g], F.lit(0.0)).alias("_most"), _solved(k, lambda _: F.lit(1e-9)).alias("_step")
    )
    both = state.join(found, [*by, "tau"]).withColumn("_taken", F.col("size").isNull() | (F.col("_size") < F.col("size")))
    pick = lambda new, old: F.when(F.col("_taken"), new).otherwise(old)
    both = both.withColumn("_b", pick(F.col("trial"), F.col("b"))).withColumn("_s", pick(F.col("_step"), F.col("step"))).withColumn("_t", pick(F.lit(1.0), F.col("t") / 2))
    done = (F.col("_taken") & (F.col("_most") < FLAT)) | (F.col("_t") <= SMALLEST)
    return both.select(
        *by, "n", "h", "tau", F.zip_with("_b", "_s", lambda x, s: x - F.col("_t") * s).alias("trial"), F.col("_b").alias("b"), pick(F.col("_size"), F.col("size")).alias("size"),
        F.col("_s").alias("step"), F.col("_t").alias("t"), done.alias("done"),
    )


def _alone(left: DataFrame, rows: DataFrame, by: list[str], k: int, bandwidth: float | None) -> DataFrame:
    """by, tau and b of the fits in ``left``, each solved by itself on its window's rows."""

    @F.pandas_udf("array<double>")
    def solve(ys: pd.Series, zs: pd.Series, taus: pd.Series) -> pd.Series:
        out = []
        for y, z, tau in zip(ys, zs, taus):
            try:
                out.append(smooth_quantiles(np.stack(z)[:, 1:], np.array(y), [tau], bandwidth)[0])
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out)

    row = F.struct("y", F.array(*[f"z{i}" for i in range(k)]).alias("z"))
    windows = rows.join(left.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.collect_list(row).alias("rows"))
    return left.select(*by, "tau").join(windows, by).select(*by, "tau", solve("rows.y", "rows.z", "tau").alias("b"))


def smooth_quantile_fits(rows: DataFrame, by: list[str], k: int, taus: list[float], bandwidth: float | None = None) -> DataFrame:
    """by, tau and b (array of k coefficients): a fit for each level of each group of ``rows`` (by, z array of k numbers, y).

    The loss is the check loss smoothed by a logistic kernel.  The bandwidth is in units
    of the residual spread of a least squares fit; by default ``max(0.05, ((k + log n) /
    n) ** 0.4)`` for n rows.  ``b`` is NULL where the numbers of a fit overflow.  A group is
    a training window; k is small, as a step takes k (k + 3) / 2 sums.
    """
    flat = stored(rows.select(*by, "y", *[F.col("z")[i].alias(f"z{i}") for i in range(k)]), "fit-rows")
    none = F.lit(None)
    state = _started(flat, by, k, taus, bandwidth).withColumns({"b": none.cast("array<double>"), "size": none.cast("double"), "step": none.cast("array<double>"), "t": F.lit(1.0), "done": F.lit(False)})
    finished = []
    for _ in range(STEPS):
        state = stored(_moved(state, flat, by, k), "newton")
        finished.append(state.where("done").select(*by, "tau", "b"))
        state = state.where("not done")
        if state.isEmpty():
            break
    else:
        finished.append(_alone(state, flat, by, k, bandwidth))
    good = F.forall("b", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return reduce(DataFrame.unionByName, finished).withColumn("b", F.when(good, F.col("b")))
