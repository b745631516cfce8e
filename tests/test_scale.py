"""Operators that must not hold a group, a window or an outline in one place."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.functions.columns import erfc
from slotcast.operators import metrics, panel, scaling, selection, spatial, timegrid
from slotcast.sources import readers, shared, writers

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def linear(values, share):
    values = sorted(values)
    at = (len(values) - 1) * share
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if at == math.floor(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize(("borders", "few"), [(63, 4096), (5, 10), (15, 3)])
def test_quantiles_by_narrowing(spark, borders, few):
    rng = np.random.default_rng(2)
    groups = {
        "wide": rng.normal(size=300).tolist(), "ties": rng.integers(0, 3, 200).astype(float).tolist(), "one": [5.0], "same": [2.5] * 40, "two": [1.0, 4.0],
        "scales": [10.0**k for k in range(-30, 31)] + [0.0] * 5, "ends": [float("inf"), float("-inf"), 1.0, 2.0, 3.0, float("inf")], "extreme": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0],
        None: [3.0, 1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None), ("wide", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: (r["n"], r["q"]) for r in selection.exact_quantiles(df, ["k"], "v", SHARES, borders, few).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k][0] == len(values)
        for share, q in zip(SHARES, got[k][1]):
            want = linear(values, share)
            assert q == want or (math.isnan(q) and math.isnan(want)), (k, share)


def test_quantiles_of_no_rows_and_no_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert selection.exact_quantiles(df, [], "v", [0.5, 0.25], 15, 10).first()["q"] == [500.0, 250.0]
    assert selection.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_no_group_meets_in_one_percentile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(9)], "k string, value double")
    assert "percentile" not in scaling.robust_params(df, ["k"])._jdf.queryExecution().toString()
    row = scaling.robust_params(df, ["k"]).first()
    assert row["center"] == 4.0 and row["scale"] == pytest.approx(2 / 0.67448975)


def test_rolling_facts_equal_dealt_windows(spark):
    rng = np.random.default_rng(8)
    first = dt.date(2026, 1, 1)
    rows = [("price", f"f{j}", first + dt.timedelta(i), float(rng.normal())) for i in range(60) for j in range(3) if rng.random() < 0.8]
    rows += [("ssrd", "late", first + dt.timedelta(50), None), ("ssrd", "late", first + dt.timedelta(52), 7.0), rows[0]]
    df = spark.createDataFrame(rows, "family string, feature string, date date, value double")
    days = spark.createDataFrame([(first + dt.timedelta(i),) for i in (0, 10, 30, 53, 59, 80, 400)], "day date")
    got = scaling.fold_params(days, df, 21)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "percentile" not in plan
    found = {(r["day"], r["feature"]): r for r in got.collect()}
    dealt = panel.rolling_window(days, df, 21).groupBy("day", "feature").agg(F.collect_list("value").alias("v"), F.count("*").alias("n")).collect()
    assert set(found) == {(r["day"], r["feature"]) for r in dealt}
    for r in dealt:
        own = found[r["day"], r["feature"]]
        if r["v"]:
            center = float(np.median(r["v"]))
            mad = float(np.median(np.abs(np.array(r["v"]) - center))) / 0.67448975
            assert own["center"] == pytest.approx(center) and own["scale"] == pytest.approx(mad if mad > 1e-12 else 1.0) and own["range"] == pytest.approx(max(r["v"]) - min(r["v"]))


def test_region_of_a_million_edges(spark):
    n = 1_000_000
    at = lambda i, f: f(2 * math.pi / n * i)
    i = F.col("id")
    edges = spark.range(n).select(at(i, F.cos).alias("lon1"), at(i, F.sin).alias("lat1"), at(i + 1, F.cos).alias("lon2"), at(i + 1, F.sin).alias("lat2"))
    rng = np.random.default_rng(4)
    rows = [(float(x), float(y)) for x, y in rng.uniform(-1.3, 1.3, (500, 2))]
    points = spark.createDataFrame([*rows, rows[0], (None, 0.0)], "lon double, lat double")
    plain = spatial.region_mask(points, edges)
    assert "Cartesian" not in plain._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in plain._jdf.queryExecution().executedPlan().toString()
    got = [(r["lon"], r["lat"], r["inside"]) for r in plain.collect()]
    assert len(got) == 502 and all(inside == (x is not None and math.hypot(x, y) < 1) for x, y, inside in got if x is None or abs(math.hypot(x, y) - 1) > 1e-6)
    km = math.radians(1) * spatial.EARTH_KM
    wide = spatial.region_mask(points, edges, 10.0).collect()
    assert all(r["inside"] == (math.hypot(r["lon"], r["lat"]) < 1 + 10 / km) for r in wide if r["lon"] is not None and abs(math.hypot(r["lon"], r["lat"]) - 1 - 10 / km) > 1e-3)


def test_region_with_long_edges_against_all_pairs(spark):
    """A triangle with a hole, long edges and a wide buffer at high latitude."""
    ring = [(10.0, 60.0), (14.0, 60.5), (11.0, 63.0), (10.0, 60.0)]
    hole = [(11.0, 60.8), (12.0, 60.9), (11.3, 61.6), (11.0, 60.8)]
    edges = spark.createDataFrame([(*a, *b) for r in (ring, hole) for a, b in zip(r, r[1:])], "lon1 double, lat1 double, lon2 double, lat2 double")
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rng.uniform(8, 16, 400), rng.uniform(59, 64, 400))], "lon double, lat double")
    spans = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    pairs = points.crossJoin(edges).groupBy("lon", "lat").agg(
        (F.count_if(spans & (F.col("lon") < at)) % 2 == 1).alias("in"), F.min(spatial._edge_kilometres(F.col("lon"), F.col("lat"))).alias("km")
    )
    for km in (0.0, 5.0, 40.0):
        want = {(r["lon"], r["lat"]): r["in"] or r["km"] <= km for r in pairs.collect()}
        got = {(r["lon"], r["lat"]): r["inside"] for r in spatial.region_mask(points, edges, km).collect()}
        assert got == want and 0 < sum(got.values()) < 400


def test_buffer_of_many_edges_against_all_pairs(spark):
    """A ring of short edges with two long ones, at high latitude and across the equator: no point meets all edges."""
    rng = np.random.default_rng(8)
    for north in (0.0, 68.0):
        ring = [(0.3 * math.cos(a), north + 0.2 * math.sin(a) + 0.02 * math.sin(5 * a)) for a in np.linspace(0, 1.7 * math.pi, 600)]
        ring = [*ring, (0.0, north), ring[0]]
        edges = spark.createDataFrame([(float(p), float(q), float(r), float(s)) for (p, q), (r, s) in zip(ring, ring[1:])], "lon1 double, lat1 double, lon2 double, lat2 double")
        points = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rng.uniform(-1.2, 1.2, 1500), rng.uniform(north - 0.6, north + 0.6, 1500))], "lon double, lat double")
        spans = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
        at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * F.try_divide(F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1"))
        pairs = points.crossJoin(edges).groupBy("lon", "lat").agg(
            (F.count_if(F.coalesce(spans & (F.col("lon") < at), F.lit(False))) % 2 == 1).alias("in"), F.min(spatial._edge_kilometres(F.col("lon"), F.col("lat"))).alias("km")
        )
        rows = pairs.collect()
        for km in (6.0, 25.0):
            want = {(r["lon"], r["lat"]): r["in"] or r["km"] <= km for r in rows}
            got = {(r["lon"], r["lat"]): r["inside"] for r in spatial.region_mask(points, edges, km).collect()}
            assert got == want and 0 < sum(got.values()) < 1500


def test_points_of_a_buffer_meet_few_edges(spark, monkeypatch):
    """Distances to edges are asked of few pairs: 2,000 points and 2,000 edges made 4 million pairs before."""
    ring = [(0.1 * math.cos(a), 0.1 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 2001)]
    edges = spark.createDataFrame([(float(p), float(q), float(r), float(s)) for (p, q), (r, s) in zip(ring, ring[1:])], "lon1 double, lat1 double, lon2 double, lat2 double")
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(float(x), float(y)) for x, y in rng.normal(0, 0.12, (2000, 2))], "lon double, lat double")
    asked, plain = spark.sparkContext.accumulator(0), spatial._edge_kilometres
    ask = F.udf(lambda km: asked.add(1) or km, "double").asNondeterministic()
    monkeypatch.setattr(spatial, "_edge_kilometres", lambda *a: ask(plain(*a)))
    assert spatial.region_mask(points, edges, 25.0).where("inside").count() > 1900
    assert 0 < asked.value < 400_000


def test_gaps_across_partitions(spark):
    rng = np.random.default_rng(1)
    values = sorted({round(float(v), 2) for v in rng.uniform(0, 50, 300)})
    df = spark.createDataFrame([(v,) for v in values + values[:20]] + [(None,)], "lon double").repartition(7)
    gaps = sorted(r["gap"] for r in spatial.coordinate_gaps(df, "lon").collect())
    assert gaps == pytest.approx(sorted(b - a for a, b in zip(values, values[1:])))
    assert selection.grid_spacing(df, "lon").first()["gap"] == pytest.approx(float(np.median(gaps)))


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.5, 1.9999, 2.0, 2.5, 3.0, 5.0, 9.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(erfc("x")).collect()]
    for x, v in zip(xs, got):
        assert v == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-14), x


def test_wall_clock_and_back(spark):
    df = spark.createDataFrame([("2025-10-26T00:30:00Z",), ("2025-10-26T01:30:00Z",), ("2026-03-29T01:30:00Z",)], "s string").select(F.to_timestamp("s").alias("ts"))
    local = [str(r["ts"]) for r in timegrid.wall_clock(df).collect()]
    assert local == ["2025-10-26 02:30:00", "2025-10-26 02:30:00", "2026-03-29 03:30:00"]
    noon = spark.createDataFrame([("2025-07-01T10:00:00Z",)], "s string").select(F.to_timestamp("s").alias("ts"))
    assert timegrid.localise(timegrid.wall_clock(noon), "ts", "Europe/Berlin").first() == noon.first()


def runs(spark, value=1.0):
    rows = [(dt.datetime(2025, 11, d, h), c, value + c, f"dwd_icon_daily_2025110{d}_09", f"u10_ms_2025110{d}09.csv") for d in (1, 2, 3) for h in (0, 1) for c in (0, 1)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, cluster_id int, value double, run string, file string")


def test_runs_are_written_once_and_pruned(spark, tmp_path):
    root = f"{tmp_path}/runs"
    writers.write_cluster_runs(runs(spark).where("run not like '%03_09'"), root, 2, {"source": "x"})
    writers.write_cluster_runs(runs(spark, 50.0), root, 2, {"source": "y"})  # adds the third, leaves the others
    rows = readers.clustered_runs(spark, root, 2, "2025-11-01", 9)
    assert {(r["folder_date"].day, r["cluster_id"]): r["value"] for r in rows.collect()} == {(1, 0): 1.0, (1, 1): 2.0, (2, 0): 1.0, (2, 1): 2.0, (3, 0): 50.0, (3, 1): 51.0}
    (tmp_path / "runs" / "run=dwd_icon_daily_20251102_09" / "file=u10_ms_2025110209.csv" / "part-bad.csv").write_text("time,other\nx,y\n")
    kept = readers.clustered_runs(spark, root, 2, "2025-11-01", 9, ["2025-11-02"], "2025-11-03")
    assert "PartitionFilters: [" in (plan := kept._jdf.queryExecution().executedPlan().toString()) and "run" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {str(r["forecast_date"]) for r in kept.collect()} == {"2025-11-01", "2025-11-04"} and kept.count() == 8
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.clustered_runs(spark, root, 2, "2025-11-01", 9).collect()


def test_files_of_other_runs_are_not_opened(spark, tmp_path):
    for day, text in (("20251020", "timestamp,cluster_0\n2025-11-01 00:00:00,1.25\n"), ("20251021", "timestamp,cluster_9\nbroken\n")):
        folder = tmp_path / f"dwd_icon_daily_{day}_09"
        folder.mkdir()
        (folder / f"u10_ms_{day}09.csv").write_text(text)
    rows = readers.clustered_csv(spark, str(tmp_path), 1, "2025-10-01", 9, ["2025-10-21"])
    assert [r["value"] for r in rows.collect()] == [1.25]
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.clustered_csv(spark, str(tmp_path), 1).collect()


def test_scores_read_a_bucketed_panel_in_place(spark):
    """No shuffle after the scan: not for a day's scores, the models side by side, nor their join; NULL keys and hot dates included."""
    first = dt.date(2026, 1, 1)
    rows = [(m, None if i == 3 else first + dt.timedelta(i), s, k, float(i + k + len(m)) if (m, i) != ("b", 2) else None, float(i)) for m in ("a", "bb") for i in range(6) for s in ("x", "y") for k in range(4)]
    rows += [("a", first, "x", 100 + k, 1.0, 0.0) for k in range(200)]
    df = spark.createDataFrame(rows, "model string, date date, series string, mtu int, y_pred double, y_true double")
    kept = shared.stored_by(df, "kept-panel", ["date", "series"], 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = metrics.daily_skill(kept, ["a", "bb"], "a", ["series"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        say = lambda d: sorted(map(str, d.collect()))
        assert say(out) == say(metrics.daily_skill(df, ["a", "bb"], "a", ["series"])) and len(say(out)) == 24
        assert {(r["date"] is None, r["n_common"]) for r in out.collect()} == {(True, None), (False, 4)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    empty = shared.stored_by(df.limit(0), "empty-panel", ["date"], 2)
    assert empty.count() == 0 and empty.columns == df.columns


def test_models_side_by_side_in_one_aggregate(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 5.0), ("b", 1, 3.0, 6.0), ("b", 2, None, 7.0), ("c", 3, 1.0, 8.0)], "model string, k int, y_pred double, y_true double")
    got = {r["k"]: (r["a"], r["b"], r["y_true"]) for r in panel.pivot_models(df, ["a", "b"], ["k"]).collect()}
    assert got == {1: (2.0, 3.0, 5.0), 2: (None, None, 7.0), 3: (None, None, 8.0)}
