import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.functions import columns as C
from slotcast.functions.estimators import lasso_cv, lasso_path, smooth_quantiles
from slotcast.operators import features, forecast, importance, metrics, panel, profile, scaling, spatial, tests_stat, timegrid, validate
from slotcast.sources import readers, writers


@pytest.fixture()
def berlin(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- time --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("date", "slots"), [("2025-10-26", 100), ("2026-03-29", 92), ("2026-01-05", 96)])
def test_days_have_their_slots(berlin, date, slots):
    df = berlin.createDataFrame([("a", f"{date} 12:00:00")], "series string, t string").select("series", F.col("t").cast("timestamp").alias("ts"))
    assert timegrid.regular_grid(df, ["series"]).count() == slots


def test_autumn_hour_is_averaged(berlin):
    base = 1761436800  # 2025-10-26 00:00 UTC, 02:00 summer time; an hour later it is 02:00 again
    rows = [(base, 1.0), (base + 3600, 3.0)]
    df = berlin.createDataFrame(rows, "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value", F.lit("a").alias("series"))
    got = profile.daily_profile(timegrid.with_keys(df), ["series"]).collect()
    assert [(r["mtu"], r["value"]) for r in got] == [(8, 2.0)]


def test_days_back(berlin):
    df = berlin.sql("select timestamp'2026-03-30 00:00:00' as ts")
    calendar, absolute = df.select(timegrid.days_back("ts", 1).cast("string"), timegrid.days_back("ts", 1, True).cast("string")).first()
    assert (calendar, absolute) == ("2026-03-29 00:00:00", "2026-03-28 23:00:00")


def test_rolling_window_across_a_clock_change(berlin):
    days = berlin.sql("select date'2025-10-30' as day")
    history = timegrid.day_list(berlin, "2025-10-01", "2025-11-10").withColumn("value", F.lit(1.0))
    assert panel.rolling_window(days, history, 7).count() == 7
    assert panel.rolling_window(days, history, 7, absolute=True).count() == 6


def test_fill_stops_after_three(spark):
    df = spark.sql("select 'a' series, timestamp_ntz'2026-01-01 00:00:00' ts, 5.0D value union all select 'a', timestamp_ntz'2026-01-01 01:15:00', 7.0D")
    got = [r["value"] for r in timegrid.align(df, ["series"]).orderBy("ts").limit(6).collect()]
    assert got == [5.0, 5.0, 5.0, 5.0, None, 7.0]


def test_incomplete_days(spark):
    df = spark.sql("select 'a' series, explode(sequence(timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-01-02 22:00:00', interval 1 hour)) ts").withColumn("value", F.lit(1.0))
    got = timegrid.drop_incomplete_days(timegrid.align(df, ["series"]), ["series"]).groupBy(F.to_date("ts")).agg(F.count("value").alias("n")).orderBy("to_date(ts)").collect()
    assert [r["n"] for r in got] == [96, 0]


def test_localise_and_shift(berlin):
    df = berlin.sql("select timestamp_ntz'2026-01-01 23:00:00' as ts")
    assert timegrid.localise(df).select(F.col("ts").cast("string")).first()[0] == "2026-01-02 00:00:00"
    assert timegrid.shift(df, -15).first()["ts"] == dt.datetime(2026, 1, 1, 22, 45)
    with pytest.raises(ValueError):
        timegrid.require_rows(df.limit(0), "window")


def test_positional_and_calendar_lags(spark):
    rows = [(dt.date(2026, 1, d), "a", 0, float(d)) for d in (1, 2, 4)]
    df = spark.createDataFrame(rows, "date date, series string, mtu int, value double")
    pos = {r["date"].day: r["lag_1"] for r in profile.day_lag(df, ["series"], [1]).collect()}
    cal = {r["date"].day: r["lag_1"] for r in profile.day_lag(df, ["series"], [1], calendar=True).collect()}
    assert pos == {1: None, 2: 1.0, 4: 2.0} and cal == {1: None, 2: 1.0, 4: None}


# --- functions ---------------------------------------------------------------------------------------------------------


def test_holidays(spark):
    days = ["2026-01-01", "2026-04-03", "2026-04-06", "2026-05-14", "2026-05-25", "2026-10-03", "2026-12-24", "2026-12-25", "2026-04-05"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select("d", C.is_holiday(F.col("d").cast("date")).alias("h")).collect()
    assert [r["h"] for r in got] == [1, 1, 1, 1, 1, 1, 0, 1, 0]


def test_feature_counts():
    assert [features.feature_count(c, "era5") for c in (1, 5, 25)] == [441, 633, 1593]
    assert [features.feature_count(c, "icon") for c in (1, 5, 25)] == [609, 1473, 5793] and features.feature_count(1, "era5", True) == 537


def test_quantile_helpers(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([1.0, 2.0, 2.0],), ([1.0],)], "q array<double>")
    assert [r[0] for r in df.select(C.crosses("q")).collect()] == [True, False, False]
    assert df.select(C.crosses(C.sorted_quantiles("q")).alias("c")).where("c").count() == 0


def test_scores_satisfy_the_identity(spark):
    """Five times the mean pinball loss is W80 / 10 + W50 / 4 + |y - median| / 2."""
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal()), [float(x) for x in sorted(rng.normal(size=5))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, q array<double>")
    q = lambda i: F.element_at("q", i)
    aps = sum(C.pinball("y", q(i + 1), t) for i, t in enumerate([0.1, 0.25, 0.5, 0.75, 0.9]))
    other = C.interval_score("y", q(1), q(5), 0.8) / 10 + C.interval_score("y", q(2), q(4), 0.5) / 4 + F.abs(F.col("y") - q(3)) / 2
    assert df.select(F.max(F.abs(aps - other))).first()[0] < 1e-12


# --- estimators --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "p"), [(40, 8), (56, 120), (30, 1)])
def test_lasso_is_optimal(n, p):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, p))
    if p > 5:
        x[:, 3], x[:, 4] = x[:, 2], 1.0
    y = x[:, :1] * 2 + rng.normal(size=(n, 3)) + 5
    fit = lasso_cv(x, y)
    slope = (x - x.mean(0)).T @ (y - fit["intercept"] - x @ fit["coef"]) / n
    on = fit["coef"] != 0
    assert (np.abs(slope) <= fit["alpha"] + 1e-9).all() and np.allclose(np.abs(slope)[on], np.broadcast_to(fit["alpha"], on.shape)[on])


def test_lasso_path_starts_at_zero():
    knots, coefs = lasso_path(np.eye(3), np.array([3.0, -1.0, 0.0]))
    assert knots[0] == 3.0 and not coefs[0].any() and np.allclose(coefs[-1], [3.0, -1.0, 0.0])


def test_quantile_regression_splits_the_residuals():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=400)
    z = np.column_stack([np.ones(400), x])
    for tau, b in zip([0.1, 0.5, 0.9], smooth_quantiles(x, y, [0.1, 0.5, 0.9], 0.05)):
        assert abs((y - z @ b < 0).mean() - tau) < 0.03


def rolling(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2026, 1, 1) + dt.timedelta(d) for d in range(45)]
    x = [(d, "price", f"f{j}", 0, float(rng.normal() * 10)) for d in days for j in range(4)]
    by = {(r[0], r[2]): r[4] for r in x}
    y = [(d, m, 3 * by[d, "f0"] + m + float(rng.normal() * 0.01)) for d in days for m in range(3)]
    return (
        spark.createDataFrame(x, "date date, family string, feature string, slot int, value double"),
        spark.createDataFrame(y, "date date, mtu int, value double"),
        spark.createDataFrame([(d,) for d in days[35:38]], "day date"), {(r[0], r[1]): r[2] for r in y},
    )


def test_rolling_forecast_finds_the_signal(spark):
    x, y, days, truth = rolling(spark)
    got = forecast.rolling_point_forecast(x, y, days, 30, use_vst=False, block=2, n_alphas=40).collect()
    assert len(got) == 9 and all("f0" in r["nonzero_cols"] and r["runtime_seconds"] >= 0 for r in got)
    linear = [abs(r["y_pred"] - truth[r["day"], r["mtu"]]) for r in got]
    assert max(linear) < 25 and forecast.rolling_point_forecast(x, y, days, 30, block=3, n_alphas=20).count() == 9
    parts = forecast.rolling_contributions(x, y, days, 30, n_alphas=20)
    assert importance.anc_by_group(parts, [], ["day", "mtu"]).count() == 1
    assert forecast.degenerate_columns(x, days, 30).count() == 0


def test_rolling_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(d), 0, [v := float(rng.normal()), None if d == 40 else v], v + float(rng.normal() * 0.1)) for d in range(42)]
    df = spark.createDataFrame(rows, "date date, mtu int, x array<double>, y_true double")
    days = df.where("date >= '2026-02-10'").select(F.col("date").alias("day"))
    got = {r["day"].day: r["q"] for r in forecast.rolling_quantile_forecast(df, days, [0.1, 0.5, 0.9], 30).collect()}
    assert got[10] is None and got[11][0] < got[11][1] < got[11][2]


def test_bias_correction_equals_the_mean(spark):
    r = np.random.default_rng(2).normal(size=50)
    got = spark.range(1).select(forecast.bias_corrected(F.lit(0.7), F.lit(float(np.cosh(r).mean())), F.lit(float(np.sinh(r).mean())), F.lit(3.0), F.lit(2.0))).first()[0]
    assert got == pytest.approx(3 + 2 * np.sinh(0.7 + r).mean())
    bare = spark.range(1).select(forecast.bias_corrected(F.lit(0.7), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(3.0), F.lit(2.0))).first()[0]
    assert bare == pytest.approx(3 + 2 * math.sinh(0.7))


def test_constant_features_scale_to_one(spark):
    df = spark.createDataFrame([("a", 2.0)] * 4, "k string, value double")
    assert scaling.robust_params(df, ["k"]).first()["scale"] == 1.0
    assert scaling.degenerate(df, ["k"]).first()["degenerate"]


# --- tests -------------------------------------------------------------------------------------------------------------


def test_giacomini_white_against_least_squares(spark):
    rng = np.random.default_rng(7)
    d = rng.normal(0.3, 1.0, 60)
    rows = [("a", "b", dt.date(2026, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(d)]
    swapped = [("b", "a", r[2], -r[3]) for r in rows]
    got = {r["model_a"]: r for r in tests_stat.giacomini_white(spark.createDataFrame(rows + swapped, "model_a string, model_b string, date date, d double"), ["model_a", "model_b"]).collect()}
    z = np.column_stack([np.ones(59), d[:-1]]) * d[1:, None]
    rest = 1 - z @ np.linalg.lstsq(z, np.ones(59), rcond=None)[0]
    want = 59 * (1 - (rest**2).mean()) * np.sign(d[1:].mean())
    assert got["a"]["statistic"] == pytest.approx(want) and got["b"]["statistic"] == pytest.approx(-want)
    assert sum(r["p_value"] < 1 for r in got.values()) == 1


def test_kupiec_edges(spark):
    df = spark.createDataFrame([("none", 0)] * 5 + [("all", 1)] * 5 + [("some", 1)] * 4 + [("some", 0)], "m string, hit int")
    got = {r["m"]: r for r in tests_stat.with_p_value(tests_stat.kupiec(df, ["m"], F.lit(0.8))).collect()}
    assert got["none"]["p_value"] == got["all"]["p_value"] == 0 and got["some"]["p_value"] == pytest.approx(1.0) and got["some"]["passed"]


def test_finite_filter(spark):
    df = spark.createDataFrame([("m", float("inf"), 1.0), ("m", 2.0, 1.0), ("m", None, 1.0), ("m", float("nan"), 1.0)], "model string, y_pred double, y_true double")
    r = metrics.point_metrics(df, ["model"]).first()
    assert (r["n_obs"], r["n_inf_nan"], r["mae"]) == (1, 3, 1.0)


def test_checks_raise(spark):
    df = spark.createDataFrame([("m", 1, "x")], "model string, n int, s string")
    assert validate.non_numeric(df, ("model",)) == ["s"] and readers.first_numeric(df) == "n"
    with pytest.raises(ValueError):
        validate.require_none(df, "bad")
    with pytest.raises(ValueError):
        validate.require_columns(df, ["y_pred"])
    with pytest.raises(ValueError):
        readers.first_numeric(df.select("s"))
    assert validate.whole_days(df).count() == 1


# --- space -------------------------------------------------------------------------------------------------------------


def test_region_with_buffer(spark):
    square = [(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "lon1 double, lat1 double, lon2 double, lat2 double")
    points = spark.createDataFrame([(1.0, 1.0), (2.5, 1.0), (9.0, 9.0)], "lon double, lat double")
    inside = lambda km: [r["inside"] for r in spatial.region_mask(points, edges, km).orderBy("lon").collect()]
    assert inside(0.0) == [True, False, False] and inside(60.0) == [True, True, False]


def test_nearest_cluster_far_away(spark):
    rng = np.random.default_rng(6)
    pts = rng.uniform(-5, 5, (80, 2)).tolist() + [[300.0, -40.0]]
    mapped = rng.uniform(-5, 5, (9, 2)).tolist()
    got = spatial.nearest_cluster(
        spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, lon double, lat double"),
        spark.createDataFrame([(i, *p) for i, p in enumerate(mapped)], "cluster_id int, lon double, lat double"), "id", 0.3,
    ).collect()
    want = {i: int(np.argmin(((np.array(mapped) - p) ** 2).sum(axis=1))) for i, p in enumerate(np.array(pts))}
    assert {r["id"]: r["cluster_id"] for r in got} == want and len(got) == 81


def test_empty_cluster_has_null_means(spark):
    field = spark.createDataFrame([(1, "t1", 2.0), (1, "t1", float("nan")), (2, "t2", 4.0)], "point int, ts string, value double")
    mapping = spark.createDataFrame([(1, 0), (2, 0), (3, 7)], "point int, cluster_id int")
    got = {(r["ts"], r["cluster_id"]): r["value"] for r in spatial.cluster_means(field, mapping, ["point"], ["ts"]).collect()}
    assert got == {("t1", 0): 2.0, ("t2", 0): 4.0, ("t1", 7): None, ("t2", 7): None}


def test_flux_edges(spark):
    rows = [("a", 0, 5.0), ("a", 1, 5.0), ("a", 1, 5.0), ("a", 3, 1.0), ("b", 0, 9.0)]
    df = spark.createDataFrame(rows, "run string, h int, value double").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    got = sorted((r["run"], r["h"], r["value"]) for r in spatial.mean_to_flux(df, ["run"]).collect() if r["value"] is not None)
    assert got == [("a", 1, 5.0), ("a", 3, 0.0), ("b", 0, 9.0)]


def test_attach_names_the_gaps(spark):
    scores = spark.createDataFrame([(0, 56, 1.0)], "cluster_id int, train_days int, anc double")
    two = spark.createDataFrame([(0,), (1,)], "cluster_id int")
    with pytest.raises(ValueError, match="1"):
        spatial.attach(two, scores, 56)
    with pytest.raises(ValueError, match="56"):
        spatial.attach(two, scores, 112)


# --- files -------------------------------------------------------------------------------------------------------------


def test_clustered_files(spark, tmp_path):
    for day, hour in (("20251020", "09"), ("20251101", "09"), ("20251102", "15")):
        folder = tmp_path / "in" / f"dwd_icon_daily_{day}_{hour}"
        folder.mkdir(parents=True)
        (folder / f"u10_ms_{day}{hour}.csv").write_text("# Source: x\n# Units: m\ntimestamp,cluster_0,cluster_1\n2025-11-01 00:00:00,1.25,-0.50\n2025-11-01 01:00:00,NaN,2.0\n")
    rows = readers.with_file_attributes(readers.clustered_csv(spark, str(tmp_path / "in"), 2))
    assert rows.count() == 12 and rows.where("value is null").count() == 3
    kept = readers.select_runs(rows, "2025-10-01", 9, skip=None, shifted_since="2025-10-26")
    assert {str(r["forecast_date"]) for r in kept.collect()} == {"2025-10-20", "2025-11-02"} and {r["var"] for r in kept.collect()} == {"u10"}
    assert readers.select_runs(rows, "2025-10-01", 9, skip=["2025-10-20"]).count() == 4
    once = readers.yearly_union(kept.withColumn("rank", F.col("folder_date")), "rank")
    assert once.count() == 4


def test_bad_clustered_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("time,cluster_0\n1,2\n")
    with pytest.raises(ValueError):
        readers.clustered_csv(spark, str(tmp_path), 1)


def test_forecast_files(spark, tmp_path):
    for days in (56, 112):
        folder = tmp_path / "era5" / f"d{days}" / "c1" / "exaa"
        folder.mkdir(parents=True)
        (folder / "forecast.csv").write_text("timestamp,q0.100,q0.900,y_true\n2026-01-01T00:00:00+01:00,1,2,1.5\n2026-01-01T00:15:00+01:00,1,NaN,1.5\n")
    path = [str(tmp_path / "era5" / "*" / "*" / "*" / "forecast.csv")]
    got = readers.forecast_panel(spark, path, ["q0.100", "q0.900", "y_true"])
    assert {r["model"] for r in got.collect()} == {"era5_d56_c1_exaa", "era5_d112_c1_exaa"} and got.where("`q0.900` is null").count() == 2
    assert readers.quantiles_long(got, [0.1, 0.9], ["model", "ts"]).count() == 8
    with pytest.raises(ValueError):
        readers.forecast_panel(spark, path, ["y_pred"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 2.0)], "ts string, cluster_id int, value double")
    out = f"{tmp_path}/clusters"
    writers.write_clusters(df, out, 2, {"source": "x"})
    writers.write_clusters(df.withColumn("value", F.lit(9.0)), out, 2, {"source": "y"})
    assert [tuple(r) for r in spark.read.option("header", True).csv(out).collect()] == [("t", "1.0", "2.0")]
    writers.write_config(spark, {"name": writers.experiment_name("era5", 56, 1, "exaa"), "taus": [0.1, 0.9], "none": None}, f"{tmp_path}/config")
    assert spark.read.json(f"{tmp_path}/config").first()["name"] == "era5_d56_c1_exaa"
    writers.write_table(df, f"{tmp_path}/t", "csv")
    writers.write_table(df, f"{tmp_path}/p")
    assert readers.cluster_map(spark, _map(spark, tmp_path)).count() == 1


def _map(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0, 0)], "lon double, lat double, cluster_id int").write.parquet(f"{tmp_path}/map")
    return f"{tmp_path}/map"


def test_streaming_slot_means(spark, tmp_path):
    from slotcast import streaming

    rows = spark.sql("select explode(sequence(timestamp'2026-01-01 00:00:00', timestamp'2026-01-01 04:00:00', interval 5 minutes)) ts").withColumn("s", F.lit("a")).withColumn("value", F.lit(2.0))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming.slot_means(stream, "s").writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from slots").collect()
    assert len(got) >= 10 and {r["value"] for r in got} == {2.0}


def test_scores_of_rows_and_of_arrays_agree(spark):
    """Long quantiles with a missing level or end against the same in arrays."""
    from slotcast.operators import metrics

    taus = [0.1, 0.25, 0.5, 0.75, 0.9]
    rows = [("m", "2024-01-01", 1, 5.0, [1.0, 2.0, 3.0, 4.0, 6.0]), ("m", "2024-01-01", 2, 2.5, [1.0, 2.0, 3.0, 4.0, None]), ("m", "2024-01-02", 3, 9.0, [1.0, None, 3.0, 4.0, 6.0]), ("n", "2024-01-02", 3, None, [1.0, 2.0, 3.0, 4.0, 6.0])]
    wide = spark.createDataFrame(rows, "model string, date string, ts int, y_true double, q array<double>")
    long = wide.select("model", "date", "ts", "y_true", F.explode(F.arrays_zip(F.array(*map(F.lit, taus)).alias("tau"), "q")).alias("p")).select("model", "date", "ts", "y_true", "p.tau", "p.q")
    intervals = [("50", 0.25, 0.75), ("80", 0.1, 0.9)]
    table = {tuple(r) for r in metrics.coverage_table(long, intervals).collect()}
    assert table == {tuple(r) for r in metrics.coverage_of_arrays(wide, taus, intervals).collect()}
    assert {(r[0], r[1]): r[3] for r in table} == {("m", "50"): 2, ("m", "80"): 2, ("n", "50"): 1, ("n", "80"): 1}
    a, b = ({(r["model"], r["period"]): r for r in x.collect()} for x in (metrics.daily_scores(long), metrics.daily_scores_of_arrays(wide, taus)))
    assert a.keys() == b.keys() and all(list(a[k].asDict().values())[2:] == pytest.approx(list(b[k].asDict().values())[2:], nan_ok=True) or None in a[k].asDict().values() for k in a)
    slots = {r["ts"]: r["aps"] for r in metrics.aps_by_slot(long.where("model = 'm'"), ["ts"]).collect()}
    assert slots == pytest.approx({r["ts"]: r["aps"] for r in wide.where("model = 'm'").select("ts", metrics.mean_pinball("y_true", "q", taus).alias("aps")).collect()})


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from slotcast.sources.shared import shared_folder

    conf = SimpleNamespace(get=lambda key: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError):
            shared_folder(SimpleNamespace(sparkContext=sc))
