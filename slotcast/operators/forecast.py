"""Rolling forecasts: the windows, scales and sums are Spark's, only a fit is grouped Python."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inverse_vst, vst
from ..functions.estimators import lasso_cv
from ..sources.shared import stored
from .moments import rolling_fit_of_sums
from .panel import rolling_window
from .quantile_fit import smooth_quantile_fits
from .scaling import fold_params, rolling_robust_params, scale_fold, scale_fold_anc

_FIT = "day date, mtu int, alpha double, intercept double, y_hat double, positions array<int>, values array<double>, residuals array<double>, runtime_seconds double"


def linear_prediction(x: Column | str, coef: Column | str, intercept: Column | str) -> Column:
    """Intercept plus the sum of products of two arrays."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return c(intercept) + F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)



def bias_corrected(y_hat: Column | str, mean_cosh: Column | str, mean_sinh: Column | str, center: Column | str, scale: Column | str) -> Column:
    """Back from the transformed scale with the mean over training residuals.

    The mean of sinh(y + r) is sinh(y) mean(cosh r) + cosh(y) mean(sinh r), so two
    averages of the residuals are enough.  Without residuals it is sinh(y).
    """
    c = lambda v: F.col(v) if isinstance(v, str) else v
    y = c(y_hat)
    mean = F.coalesce(F.sinh(y) * c(mean_cosh) + F.cosh(y) * c(mean_sinh), inverse_vst(y))
    return c(center) + c(scale) * mean


def naive(panel: DataFrame, source: str, name: str) -> DataFrame:
    """A forecast that is another column of the same slot."""
    return panel.withColumn("model", F.lit(name)).withColumn("y_pred", F.col(source))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key on a fixed number of tasks: a fit is long but its rows are few, so tasks must not be merged by size."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def _arrays(train: DataFrame, test: DataFrame) -> DataFrame:
    """(day, date, is_test, x): the scaled features as an array in the order of their names.

    Dates that miss a feature of their forecast day are left out.
    """
    rows = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    whole = F.array_sort(F.collect_list(F.struct("feature", "value")))
    arrays = rows.groupBy("day", "date", "is_test").agg(F.transform(whole, lambda p: p["value"]).alias("x"))
    most = F.max(F.size("x")).over(Window.partitionBy("day"))
    return arrays.withColumn("_n", most).where(F.size("x") == F.col("_n")).drop("_n")


def _fit_block(folds: int, n_alphas: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        pdf = pdf.sort_values("date")
        train, test = pdf[~pdf["is_test"]], pdf[pdf["is_test"]]
        out = []
        if len(train) and len(test):
            x = np.array(train["x"].tolist(), float)
            day, x_day = test["day"].iloc[0], np.array(test["x"].iloc[0], float)
            slots = sorted({r["mtu"] for ys in train["y"] if ys is not None for r in ys})
            y = np.full((len(x), len(slots)), np.nan)
            at = {m: k for k, m in enumerate(slots)}
            for i, ys in enumerate(train["y"]):
                for r in ys if ys is not None else ():
                    y[i, at[r["mtu"]]] = r["y"]
            whole = ~np.isnan(y).any(axis=1)
            groups = [(whole, range(len(slots)))] if whole.all() else [(~np.isnan(y[:, k]), [k]) for k in range(len(slots))]
            for rows, ks in groups:  # slots without gaps are fitted together
                if rows.sum() < 2:
                    continue
                ks = list(ks)
                fit = lasso_cv(x[rows], y[rows][:, ks], folds, n_alphas)
                rest = y[rows][:, ks] - fit["intercept"] - x[rows] @ fit["coef"]
                for k, slot in enumerate(ks):
                    beta = fit["coef"][:, k]
                    on = np.flatnonzero(beta)
                    out.append((day, slots[slot], fit["alpha"][k], fit["intercept"][k], fit["intercept"][k] + x_day @ beta, on.tolist(), beta[on].tolist(), rest[:, k].tolist()))
        took = (time.perf_counter() - began) / max(1, len(out))
        return pd.DataFrame([(*r, took) for r in out], columns=[c.split()[0] for c in _FIT.split(", ")])

    return run


def rolling_fit(x: DataFrame, targets: DataFrame, block: int = 12, folds: int = 5, n_alphas: int = 100) -> DataFrame:
    """One sparse fit for each forecast day and slot.

    ``x`` is (day, date, is_test, x); ``targets`` (day, date, mtu, y).  A group is a
    day with ``block`` slots and holds the day's features once.  Days without a
    training row or a test row give nothing.
    """
    y = targets.withColumn("block", F.floor(F.col("mtu") / block).cast("int"))
    blocks = y.select("day", "block").distinct()
    rows = y.groupBy("day", "date", "block").agg(F.collect_list(F.struct("mtu", "y")).alias("y"))
    dealt = x.join(blocks, "day").join(rows, ["day", "date", "block"], "left")
    dealt = dealt.where("is_test or y is not null")
    return _dealt(dealt, "day", "block").groupBy("day", "block").applyInPandas(_fit_block(folds, n_alphas), _FIT)


def point_inputs(features: DataFrame, target: DataFrame, days: DataFrame, train_days: int, use_vst: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the fits of a point model see (O87): ``x`` and ``y`` of :func:`rolling_fit`, and the targets' scales by (day, mtu)."""
    train = rolling_window(days, features, train_days)
    test = days.join(features, F.col("day") == F.col("date"))
    params = fold_params(days, features, train_days)
    x = _arrays(*(scale_fold(r, params, ["day"], use_vst).select("day", "date", "feature", "value") for r in (train, test)))
    past = rolling_window(days, target, train_days).where("value is not null")
    scales = rolling_robust_params(days, target, train_days, ["mtu"])
    z = (F.col("value") - F.col("center")) / F.col("scale")
    y = past.join(scales, ["day", "mtu"]).select("day", "date", "mtu", (vst(z) if use_vst else z).alias("y"))
    return x, y, scales


def contribution_inputs(features: DataFrame, target: DataFrame, days: DataFrame, train_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the fits of a contribution model see (O88): ``x`` and ``y``, and the forecast days' scaled features in long form."""
    train = rolling_window(days, features, train_days)
    test = days.join(features, F.col("day") == F.col("date"))
    params = fold_params(days, features, train_days)
    scaled = [scale_fold_anc(r, params, ["day"]).select("day", "date", "feature", "value") for r in (train, test)]
    y = rolling_window(days, target, train_days).where("value is not null").select("day", "date", "mtu", F.col("value").alias("y"))
    return _arrays(*scaled), y, scaled[1]


def rolling_point_forecast(features: DataFrame, target: DataFrame, days: DataFrame, train_days: int, use_vst: bool = True, block: int = 12, n_alphas: int = 100) -> DataFrame:
    """day, mtu, y_pred, alpha, intercept, n_nonzero, coefficients and runtime.

    ``features`` is long (date, family, feature, value), ``target`` (date, mtu, value),
    ``days`` has day.  Scales are fitted on each day's training window; the prediction
    is brought back with the residuals' bias correction.
    """
    x, y, scales = point_inputs(features, target, days, train_days, use_vst)
    fits = rolling_fit(x, y, block, 5, n_alphas).join(scales, ["day", "mtu"])
    mean = lambda f: F.aggregate(F.transform("residuals", f), F.lit(0.0), lambda s, v: s + v) / F.size("residuals")
    back = bias_corrected("y_hat", mean(F.cosh), mean(F.sinh), "center", "scale") if use_vst else F.col("center") + F.col("scale") * F.col("y_hat")
    names = features.select("feature").distinct().agg(F.array_sort(F.collect_list("feature")).alias("names"))
    out = fits.select("day", "mtu", back.alias("y_pred"), "alpha", "intercept", F.size("positions").alias("n_nonzero"), "positions", F.col("values").alias("nonzero_vals"), "runtime_seconds")
    named = out.join(names, how="cross")  # one row: the dictionary of feature names
    return named.withColumn("nonzero_cols", F.transform("positions", lambda i: F.element_at("names", i + 1))).drop("names", "positions")


def fit_certificates(x: DataFrame, y: DataFrame, fits: DataFrame, n_alphas: int = 100, eps: float = 1e-3) -> DataFrame:
    """By (day, mtu): the conditions that hold at a LASSO optimum and nowhere else, as sums over the fold.

    With r the residuals of a fit and c_j the mean product of r and the centred feature
    j, the fit minimises |r|^2 / 2n + alpha |b| exactly if c_j = alpha sign(b_j) for
    every feature with a coefficient, |c_j| <= alpha for the others, and r has mean 0.
    The sums come from the coefficients handed back and the rows themselves, not from
    the solver.  Returned are n, n_features, alpha_max (the smallest penalty without
    coefficients), and, in units of it, ``active_gap``, ``idle_excess``, ``mean_gap`` (all
    near 0) and ``grid_gap``: the distance of alpha to its penalty grid, in steps;
    ``forecast_gap`` is that of y_hat to the prediction from the coefficients.
    """
    told = fits.select("day", "mtu", "alpha", "intercept", "y_hat", "positions", "values")
    fit_at = lambda x_: F.col("intercept") + F.aggregate(F.arrays_zip("positions", "values"), F.lit(0.0), lambda s, p: s + p["values"] * F.element_at(x_, p["positions"] + 1))
    train = x.where("not is_test").select("day", "date", "x").join(y, ["day", "date"]).join(told, ["day", "mtu"])
    rows = train.select("day", "mtu", "y", (F.col("y") - fit_at("x")).alias("r"), F.posexplode("x").alias("position", "v"))
    v, r, t = F.col("v"), F.col("r"), F.col("y")
    sums = rows.groupBy("day", "mtu", "position").agg(
        F.count("*").alias("n"), F.avg(r).alias("mean_r"), (F.avg(v * r) - F.avg(v) * F.avg(r)).alias("c"), (F.avg(v * t) - F.avg(v) * F.avg(t)).alias("c0")
    )
    coefs = told.select("day", "mtu", "alpha", F.explode(F.arrays_zip("positions", "values")).alias("p")).select("day", "mtu", F.col("p.positions").alias("position"), F.col("p.values").alias("b"))
    held = sums.join(coefs, ["day", "mtu", "position"], "left").join(told.select("day", "mtu", "alpha"), ["day", "mtu"])
    alpha, c, b = F.col("alpha"), F.col("c"), F.col("b")
    found = held.groupBy("day", "mtu", "alpha").agg(
        F.max("n").alias("n"), F.count("*").alias("n_features"), F.max(F.abs("c0")).alias("alpha_max"), F.max(F.when(b.isNotNull(), F.abs(c - alpha * F.signum(b)))).alias("active"),
        F.max(F.when(b.isNull(), F.abs(c) - alpha)).alias("idle"), F.max(F.abs("mean_r")).alias("mean"),
    )
    share = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(0.0)), F.lit(0.0)) / F.greatest("alpha_max", F.lit(1e-12))
    steps = F.log(F.greatest("alpha_max", F.lit(1e-12)) / alpha) / F.log(F.lit(1 / eps)) * (n_alphas - 1)
    grid = F.abs(steps - F.least(F.greatest(F.round(steps), F.lit(0.0)), F.lit(n_alphas - 1.0)))
    test = x.where("is_test").select("day", "x").join(told, "day").select("day", "mtu", F.abs(F.col("y_hat") - fit_at("x")).alias("forecast_gap"))
    named = [share("active").alias("active_gap"), share("idle").alias("idle_excess"), share("mean").alias("mean_gap"), grid.alias("grid_gap")]
    return found.select("day", "mtu", "n", "n_features", "alpha_max", *named).join(test, ["day", "mtu"])


def degenerate_columns(features: DataFrame, days: DataFrame, train_days: int) -> DataFrame:
    """(day, n_degenerate, degenerate_cols): solar features that a window leaves flat."""
    params = fold_params(days, features, train_days).where("degenerate")
    return params.groupBy("day").agg(F.count("*").alias("n_degenerate"), F.array_sort(F.collect_list("feature")).alias("degenerate_cols"))


def contribution_fits(features: DataFrame, target: DataFrame, days: DataFrame, train_days: int, block: int = 12, n_alphas: int = 100) -> tuple[DataFrame, DataFrame]:
    """The fits of contribution models by (day, mtu), and the forecast days' scaled features.

    Windows without gaps are fitted from sums of products, so none of their rows is
    shipped; the others from their rows.
    """
    params = fold_params(days, features, train_days)
    test = days.join(features, F.col("day") == F.col("date"))
    own = scale_fold_anc(test, params, ["day"]).select("day", "date", "feature", "value")
    fits, rest = rolling_fit_of_sums(features, target, days, params, own, train_days, 2 * block, 5, n_alphas)
    x, y, _ = contribution_inputs(features, target, stored(rest, "days-with-gaps"), train_days)
    return fits.unionByName(rolling_fit(x, y, block, 5, n_alphas).select(*fits.columns)), own


def rolling_contributions(features: DataFrame, target: DataFrame, days: DataFrame, train_days: int, block: int = 12, n_alphas: int = 100) -> DataFrame:
    """day, mtu, feature, feature_value, beta, contribution of fits without transform."""
    fits, own = contribution_fits(features, target, days, train_days, block, n_alphas)
    at = own.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("x"))
    pairs = fits.select("day", "mtu", F.explode(F.arrays_zip("positions", "values")).alias("p")).join(at, "day")
    one = F.element_at("x", F.col("p.positions") + 1)
    out = pairs.select("day", "mtu", one["feature"].alias("feature"), one["value"].alias("feature_value"), F.col("p.values").alias("beta"))
    return out.withColumn("contribution", F.col("feature_value") * F.col("beta"))


def rolling_quantile_forecast(panel: DataFrame, days: DataFrame, taus: list[float], train_days: int, keys: list[str] | None = None, bandwidth: float | None = None) -> DataFrame:
    """day, keys, mtu, q (array by level): smoothed quantile regressions on model forecasts.

    ``panel`` is (date, keys, mtu, x array of the models' forecasts, y_true).  Rows with
    NULLs are left out of the fit; NULL features of the day, or a fit that fails, give
    NULL.  All levels of all groups are fitted together; days without features give nothing.
    """
    by = ["day", *(keys or []), "mtu"]
    wide = panel.agg(F.max(F.size("x"))).first()[0]  # of one panel, every row has as many models
    if wide is None:
        return days.join(panel, F.col("day") == F.col("date")).select(*by, F.lit(None).cast("array<double>").alias("q"))
    present = lambda v: v.isNotNull() & ~F.isnan(v)
    whole = F.col("x").isNotNull() & F.forall("x", present)
    z = F.concat(F.array(F.lit(1.0)), "x")
    test = days.join(panel, F.col("day") == F.col("date")).select(*by, F.when(whole, z).alias("z"))
    good = panel.where(whole & present(F.col("y_true"))).select("date", *by[1:], z.alias("z"), F.col("y_true").cast("double").alias("y"))
    train = stored(rolling_window(days, good, train_days).select(*by, "z", "y"), "windows")
    enough = train.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > wide + 1)
    wanted = test.where("z is not null").select(*by).join(enough.select(*by), by)
    fits = smooth_quantile_fits(train.join(wanted, by, "left_semi"), by, wide + 1, taus, bandwidth)
    told = test.join(fits, by, "left")
    levels = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("tau", linear_prediction("z", "b", F.lit(0.0)).alias("q")))).alias("levels"))
    place = F.array(*[F.lit(float(t)) for t in sorted(taus)])
    q = F.transform(F.array(*[F.lit(float(t)) for t in taus]), lambda t: F.element_at("levels", F.array_position(place, t).cast("int"))["q"])
    return levels.select(*by, F.when(F.forall("levels", lambda v: v["q"].isNotNull()), q).alias("q"))
