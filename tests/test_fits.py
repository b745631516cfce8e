"""Fits against their own conditions and against fits made one by one."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.functions.estimators import smooth_quantiles
from slotcast.operators import forecast, quantile_fit


def folds(spark, n=40, p=5, slots=3, seed=0):
    rng = np.random.default_rng(seed)
    days = [dt.date(2026, 3, 1), dt.date(2026, 3, 2)]
    x, y = [], []
    for day in days:
        for i in range(n + 1):
            date = day - dt.timedelta(n - i)
            v = rng.normal(size=p)
            x.append((day, date, i == n, v.tolist()))
            y += [(day, date, m, float(2 * v[0] - v[1] + rng.normal())) for m in range(slots) if i < n]
    return spark.createDataFrame(x, "day date, date date, is_test boolean, x array<double>"), spark.createDataFrame(y, "day date, date date, mtu int, y double")


GAPS = ["active_gap", "idle_excess", "mean_gap", "grid_gap", "forecast_gap"]


def test_certificates_hold_for_fits_and_fail_for_others(spark):
    x, y = folds(spark)
    fits = forecast.rolling_fit(x, y, n_alphas=50).cache()
    good = forecast.fit_certificates(x, y, fits, 50).collect()
    assert len(good) == 6 and all(r[g] < 1e-9 for r in good for g in GAPS[:3]) and all(r["grid_gap"] < 1e-9 and r["forecast_gap"] < 1e-9 for r in good)
    assert all(r["n"] == 40 and r["n_features"] == 5 for r in good)
    moved = forecast.fit_certificates(x, y, fits.withColumn("values", F.transform("values", lambda v: v * 1.01)), 50).collect()
    assert all(r["active_gap"] > 1e-4 and r["forecast_gap"] > 1e-4 for r in moved)
    shifted = forecast.fit_certificates(x, y, fits.withColumn("intercept", F.col("intercept") + 0.1), 50).collect()
    assert all(r["mean_gap"] > 1e-3 for r in shifted)
    fewer = forecast.fit_certificates(x, y, fits.withColumn("positions", F.slice("positions", 2, 9)).withColumn("values", F.slice("values", 2, 9)), 50).collect()
    assert all(r["idle_excess"] > 1e-3 for r in fewer)


def test_certificates_of_null_fits(spark):
    """Targets without variance: no coefficient, and nothing to complain of."""
    x, y = folds(spark)
    flat = y.withColumn("y", F.lit(3.0))
    got = forecast.fit_certificates(x, flat, forecast.rolling_fit(x, flat)).collect()
    assert len(got) == 6 and all(abs(r["alpha_max"]) < 1e-12 and r["active_gap"] == 0 and r["mean_gap"] < 1e-3 for r in got)


def quantile_rows(spark, seed=1, groups=6, n=30, k=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for _ in range(n):
            v = (rng.normal(size=k - 1) * 20 + 60).tolist()
            rows.append((g, [1.0, *v], float(sum(v) / 2 + rng.normal() * (1 + g))))
    return rows, spark.createDataFrame(rows, "g int, z array<double>, y double")


@pytest.mark.parametrize("steps", [quantile_fit.STEPS, 1])
@pytest.mark.parametrize("bandwidth", [None, 0.02])
def test_fits_together_equal_fits_one_by_one(spark, monkeypatch, steps, bandwidth):
    monkeypatch.setattr(quantile_fit, "STEPS", steps)
    taus = [0.1, 0.5, 0.9]
    rows, df = quantile_rows(spark)
    got = {(r["g"], r["tau"]): r["b"] for r in quantile_fit.smooth_quantile_fits(df, ["g"], 3, taus, bandwidth).collect()}
    assert len(got) == 18
    for g in range(6):
        own = [r for r in rows if r[0] == g]
        want = smooth_quantiles(np.array([r[1][1:] for r in own]), np.array([r[2] for r in own]), taus, bandwidth)
        assert np.abs(want - [got[g, t] for t in taus]).max() < 1e-6


def test_constant_columns_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0], float(i)) for i in range(9)], "g int, z array<double>, y double")
    b = quantile_fit.smooth_quantile_fits(df, ["g"], 2, [0.5]).first()["b"]
    assert b[0] + 5 * b[1] == pytest.approx(4.0, abs=1e-4)
    assert quantile_fit.smooth_quantile_fits(df.limit(0), ["g"], 2, [0.5]).count() == 0


def test_quantile_forecast_edges(spark):
    """Too few rows, missing features of the day and an unsorted list of levels."""
    base = dt.date(2026, 1, 1)
    rng = np.random.default_rng(9)
    rows = [(base + dt.timedelta(i), m, [float(v := rng.normal())], float(v + rng.normal() * 0.1)) for i in range(20) for m in range(2)]
    rows = [(d, m, None if (d, m) == (base + dt.timedelta(19), 1) else x, y if d.day % 7 else None) for d, m, x, y in rows]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "mtu", "x", "y_true"]).astype({"mtu": "int32"}), "date date, mtu int, x array<double>, y_true double")
    days = df.select(F.col("date").alias("day")).where("day in ('2026-01-02', '2026-01-20')").distinct()
    got = {(r["day"].day, r["mtu"]): r["q"] for r in forecast.rolling_quantile_forecast(df, days, [0.9, 0.1], 14).collect()}
    assert got[2, 0] is None and got[2, 1] is None and got[20, 1] is None and got[20, 0][0] > got[20, 0][1]


def test_spanned_features_may_enter_again():
    """Few rows, flags that add up and lags: what the active features span is kept out only until one of them leaves."""
    from slotcast.functions.estimators import lasso_cv

    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(12, 26))
        flags = np.eye(7)[np.arange(n) % 7]
        x = np.column_stack([flags, flags[:, :2].sum(axis=1), rng.normal(size=(n, 15)).round(1), rng.integers(0, 2, (n, 2))])
        y = rng.normal(size=(n, 2)).cumsum(axis=0)
        fit = lasso_cv(x, y, n_alphas=60)
        slope = (x - x.mean(0)).T @ (y - fit["intercept"] - x @ fit["coef"]) / n
        assert (np.abs(slope) <= fit["alpha"] * (1 + 1e-8) + 1e-10).all()


def contribution_rows(n=40, p=6, slots=3, seed=4):
    """Rows of features and targets by date, some with gaps; one feature far from 0, one flat, one lacking for a while."""
    rng = np.random.default_rng(seed)
    first = dt.date(2026, 1, 1)
    x, y = [], []
    for i in range(n):
        date = first + dt.timedelta(i)
        v = rng.normal(size=p)
        for j in range(p):
            value = float(1e6 + v[j]) if j == 1 else 3.0 if j == 2 else float(v[j])
            if (i, j) != (9, 3):
                x.append((date, "calendar" if j == 4 else "price", f"f{j}", value))
        y += [(date, m, float(2 * v[0] - v[1] + m * v[5] + rng.normal() * 0.1)) for m in range(slots) if (i, m) != (20, 1)]
    return x, y


@pytest.mark.parametrize(("train", "block", "p"), [(9, 12, 6), (9, 1, 14), (1, 12, 6)])
def test_fits_of_sums_equal_fits_of_rows(spark, train, block, p):
    x, y = contribution_rows(p=p)
    features = spark.createDataFrame(x, "date date, family string, feature string, value double").repartition(3)
    target = spark.createDataFrame(y, "date date, mtu int, value double").repartition(3)
    days = features.select(F.col("date").alias("day")).distinct()
    rows_x, rows_y, _ = forecast.contribution_inputs(features, target, days, train)
    want = {(r["day"], r["mtu"]): r for r in forecast.rolling_fit(rows_x, rows_y, block, 5, 50).collect()}
    fits, _ = forecast.contribution_fits(features, target, days, train, block, 50)
    got = {(r["day"], r["mtu"]): r for r in fits.collect()}
    assert set(got) == set(want) and (train == 1 or len(got) > 60)
    for at, r in got.items():
        assert r["positions"] == want[at]["positions"] and r["values"] == pytest.approx(want[at]["values"], rel=1e-7, abs=1e-9)
        assert r["y_hat"] == pytest.approx(want[at]["y_hat"], abs=1e-8) and r["alpha"] == pytest.approx(want[at]["alpha"], rel=1e-8)


def test_days_left_to_the_fits_of_rows(spark):
    """A date that misses a feature or a target sends just the days that look back on it to their rows."""
    from slotcast.operators import moments, scaling

    x, y = contribution_rows()
    y.append((x[0][0] + dt.timedelta(30), 0, float("nan")))  # twice, and not finite
    features = spark.createDataFrame(x, "date date, family string, feature string, value double")
    target = spark.createDataFrame(y, "date date, mtu int, value double")
    days = features.select(F.col("date").alias("day")).distinct()
    params = scaling.fold_params(days, features, 5)
    own = scaling.scale_fold_anc(days.join(features, F.col("day") == F.col("date")), params, ["day"])
    fits, rest = moments.rolling_fit_of_sums(features, target, days, params, own, 5)
    gaps = {d for g in (9, 20, 30) for d in range(g + 1, g + 6)} | set(range(5))
    assert {(r["day"] - x[0][0]).days for r in rest.collect()} == gaps
    assert {(r["day"] - x[0][0]).days for r in fits.select("day").collect()} == set(range(40)) - gaps - {9}  # no forecast without all features
    assert moments.rolling_fit_of_sums(features.limit(0), target, days, params, own, 5)[0].count() == 0


def test_no_row_of_a_whole_window_reaches_python(spark):
    from slotcast.operators import moments

    x, y = contribution_rows()
    features = spark.createDataFrame(x, "date date, family string, feature string, value double")
    w, _ = moments.complete_dates(features, spark.createDataFrame(y, "date date, mtu int, value double"))
    days = w.select(F.date_add("date", 1).alias("day"))
    plan = moments.fold_sums(w, days, 5, 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.split("== Physical Plan ==")[1].count("Window ") <= 2
