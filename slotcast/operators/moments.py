"""Sparse fits from sums of products: the rows of a window never leave the JVM.

Min-max scaling is affine, so what a fit needs of a window, x'x and x'y by fold, follows
from sums of daily products over moving frames; the window's scale is applied to the
matrix.  Frames are summed anew for each day: differences of running totals would carry
the digits of all days before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY, is_finite
from ..functions.estimators import lasso_cv_of_sums
from ..sources.shared import stored
from .panel import rolling_window
from .scaling import PLAIN

_FIT = "day date, place int, alpha double, intercept double, y_hat double, positions array<int>, values array<double>"


def _listed(rows: DataFrame, key: str) -> DataFrame:
    """One row: the keys in order (``{key}s``) and the mean of each (``{key}_means``)."""
    value = F.col("value")
    means = rows.groupBy(key).agg(F.coalesce(F.avg(F.when(is_finite("value"), value)), F.lit(0.0)).alias("mean"))
    pairs = means.agg(F.array_sort(F.collect_list(F.struct(key, "mean"))).alias("pairs"))
    return pairs.select(F.transform("pairs", lambda p: p[key]).alias(f"{key}s"), F.transform("pairs", lambda p: p["mean"]).alias(f"{key}_means"))


def _by_date(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(key, F.col("value").cast("double").alias("value")))).alias(key))


def complete_dates(features: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(date, w): 1, the features and the targets of each date that has each of them once, finite, less their means; and the one-row lists."""
    lists = _listed(features, "feature").join(_listed(target, "mtu"), how="cross")  # one row each
    days = _by_date(features, "feature").join(_by_date(target, "mtu"), "date").join(F.broadcast(lists), how="cross")
    good = lambda key: (F.transform(key, lambda p: p[key]) == F.col(f"{key}s")) & F.forall(key, lambda p: is_finite(p["value"]))
    less = lambda key: F.zip_with(key, f"{key}_means", lambda p, m: p["value"] - m)
    whole = days.where(F.coalesce(good("feature") & good("mtu"), F.lit(False)))
    return whole.select("date", F.size("features").alias("p"), F.concat(F.array(F.lit(1.0)), less("feature"), less("mtu")).alias("w")), lists


def fold_sums(w: DataFrame, days: DataFrame, n: int, folds: int) -> DataFrame:
    """(day, j, k, p, s0, s1, ...): sums of the products of entries j <= k of ``w`` over each fold of the n rows before ``day``.

    ``days`` are forecast days with a row on each of the n dates before them.  A pair's
    products lie in the order of time in one window; no row is dealt to the days that
    see it.  Pairs of targets are not needed.
    """
    left = w.select("date", "p", "w", F.posexplode(F.slice("w", 1, F.col("p") + 1)).alias("j", "_a"))
    right = F.slice("w", F.col("j") + 1, F.size("w") - F.col("j"))
    pairs = left.select("date", "p", "j", "_a", F.posexplode(right).alias("_k", "_b"))
    products = pairs.select("date", "p", "j", (F.col("j") + F.col("_k")).alias("k"), (F.col("_a") * F.col("_b")).alias("v"))
    order = Window.partitionBy("j", "k").orderBy("date")
    sizes = [len(part) for part in np.array_split(np.arange(n), folds)]
    ends = np.cumsum(sizes)
    frames = [F.sum("v").over(order.rowsBetween(int(e - size) - n + 1, int(e) - n)).alias(f"s{i}") for i, (e, size) in enumerate(zip(ends, sizes))]
    told = products.select(F.date_add("date", 1).alias("day"), "p", "j", "k", *frames)
    return told.join(days, "day", "left_semi")


def affine(features: DataFrame, params: DataFrame) -> DataFrame:
    """(day, feature, scale, base): the scaling of contribution models as ``scale * value + base``."""
    usable = (F.col("range") > TINY) & (F.col("range") < float("inf"))
    plain = F.col("family").isin(*PLAIN)
    scale = F.when(F.col("degenerate"), 0.0).when(plain, 1.0).when(usable, 1 / F.col("range")).otherwise(0.0)
    base = F.when(F.col("degenerate") | plain | ~usable, 0.0).otherwise(-F.col("low") / F.col("range"))
    return params.select("day", "feature", scale.alias("scale"), base.alias("base"))


def _fit_sums(folds: int, n_alphas: int):
    def run(key: tuple, sums: pd.DataFrame, scales: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(sums) and len(scales):
            p = int(sums["p"].iloc[0])
            scales = scales.sort_values("position")
            j, k = sums["j"].to_numpy(), sums["k"].to_numpy()
            targets = np.unique(k[k > p])  # this block's
            k = np.where(k > p, p + 1 + np.searchsorted(targets, k), k)
            matrix = np.zeros((folds, p + 1, p + 1 + len(targets)))
            for i in range(folds):
                matrix[i, j, k] = sums[f"s{i}"]
            inner = matrix[:, :, : p + 1]
            inner += np.triu(inner, 1).transpose(0, 2, 1)  # a copy of what lies above the diagonal
            if len(scales) == p and len(targets):
                x_day = scales["value"].to_numpy()
                fit = lasso_cv_of_sums(matrix, scales["scale"].to_numpy(), scales["shift"].to_numpy(), n_alphas)
                for i, place in enumerate(targets - p - 1):
                    beta = fit["coef"][:, i]
                    on = np.flatnonzero(beta)
                    out.append((key[0], int(place), fit["alpha"][i], fit["intercept"][i], fit["intercept"][i] + x_day @ beta, on.tolist(), beta[on].tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FIT.split(", ")])

    return run


def rolling_fit_of_sums(
    features: DataFrame, target: DataFrame, days: DataFrame, params: DataFrame, own: DataFrame, n: int, block: int = 24, folds: int = 5, n_alphas: int = 100
) -> tuple[DataFrame, DataFrame]:
    """The fits of contribution models by (day, mtu), and the forecast days that they leave to the fits from rows.

    ``params`` are the folds' scales, ``own`` the scaled features of the forecast days
    (day, feature, value).  Left over are days with a date among the n before them
    that is missing, or misses a feature or a target, or has one twice or not finite.
    A group is a day with ``block`` targets.
    """
    folds = min(folds, n)
    w, lists = complete_dates(features, target)
    w, lists = stored(w, "complete-dates"), stored(lists, "lists")
    seen = rolling_window(days.select("day").distinct(), w.select("date"), n).groupBy("day").agg(F.count("*").alias("_n"))
    whole = stored(seen.where((F.col("_n") == n) & (F.col("_n") > 1)).select("day"), "whole-windows")
    sums = fold_sums(w, whole, n, folds)
    target_of: Column = F.col("k") - F.col("p") - 1
    last = w.agg(F.max(F.size("w") - F.col("p") - 2)).first()[0] or 0
    blocks = F.when(target_of < 0, F.sequence(F.lit(0), F.lit(int(last) // block))).otherwise(F.array(F.floor(target_of / block).cast("int")))
    dealt = sums.withColumn("block", F.explode(blocks))
    means = lists.select(F.posexplode(F.arrays_zip("features", "feature_means")).alias("position", "f")).select("position", "f.*")
    scales = affine(features, params).join(F.broadcast(means), F.col("feature") == F.col("features"))
    scales = scales.join(own.select("day", "feature", "value").where("value is not null"), ["day", "feature"])
    scales = scales.select("day", "position", "scale", (F.col("scale") * F.col("feature_means") + F.col("base")).alias("shift"), "value")
    scales = scales.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(last) // block))))
    fits = dealt.groupBy("day", "block").cogroup(scales.groupBy("day", "block")).applyInPandas(_fit_sums(folds, n_alphas), _FIT)
    named = fits.join(F.broadcast(lists.select("mtus", "mtu_means")), how="cross")  # one row
    at = lambda c: F.element_at(c, F.col("place") + 1)
    told = named.select("day", at("mtus").alias("mtu"), "alpha", (F.col("intercept") + at("mtu_means")).alias("intercept"), (F.col("y_hat") + at("mtu_means")).alias("y_hat"), "positions", "values")
    return told, days.join(whole, "day", "left_anti")
