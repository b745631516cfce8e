"""Queries on features, scales, rolling windows, space and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features, forecast, importance, panel, profile, scaling, selection, spatial, timegrid
from ..sources.shared import stored
from .grid_queries import slots
from .registry import SQL, also, day, query, r6, steady, table

MONTHLY = "m AS (SELECT l_returnflag AS feature, strftime(l_shipdate, '%Y-%m') AS month, l_extendedprice AS value FROM lineitem)"


def monthly(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feature"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_extendedprice").alias("value"))


@query(f"""WITH {MONTHLY}, c AS (SELECT feature, month, median(value) AS center FROM m GROUP BY 1, 2),
s AS (SELECT m.feature, m.month, max(center) AS center, median(abs(value - center)) / {C.MAD_TO_SD} AS scale FROM m JOIN c ON c.feature = m.feature AND c.month = m.month GROUP BY 1, 2)
SELECT feature, month, round(center, 4) AS center, round(CASE WHEN scale > 1e-12 THEN scale ELSE 1 END, 4) AS scale FROM s""")
def robust_scale(spark, sf_dir):
    """Median and scaled MAD by month."""
    out = scaling.robust_params(monthly(spark, sf_dir), ["feature", "month"])
    return out.select("feature", "month", F.round("center", 4).alias("center"), F.round("scale", 4).alias("scale"))


@query(f"""WITH {MONTHLY}, p AS (SELECT feature, month, min(value) AS low, max(value) - min(value) AS span FROM m GROUP BY 1, 2)
SELECT m.feature AS feature, m.month AS month, count(*) AS n, round(avg(CASE WHEN span > 1e-12 THEN (value - low) / span ELSE 0 END), 6) AS mean_scaled FROM m JOIN p ON p.feature = m.feature AND p.month = m.month GROUP BY 1, 2""")
def minmax_scale(spark, sf_dir):
    """Min-max scaled prices, averaged by month."""
    rows = monthly(spark, sf_dir)
    scaled = rows.join(scaling.minmax_params(rows, ["feature", "month"]), ["feature", "month"])
    value = scaling.minmax(F.col("value"), F.col("low"), F.col("range"))
    return scaled.groupBy("feature", "month").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_scaled"))


@query("""WITH m AS (SELECT l_returnflag AS feature, CAST(l_shipdate AS DATE) AS date, l_discount * 500 - 5 AS value FROM lineitem)
SELECT feature, CAST(date AS VARCHAR) AS date, max(value) - min(value) < 20 OR avg(CASE WHEN value > 0 THEN 1 ELSE 0 END) < 0.5 OR quantile_cont(value, 0.75) - quantile_cont(value, 0.25) < 8 AS degenerate FROM m GROUP BY 1, 2""")
def degenerate_filter(spark, sf_dir):
    """Flat or mostly non-positive features by day."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feature"), F.to_date("l_shipdate").alias("date"), (F.col("l_discount") * 500 - 5).alias("value"))
    return scaling.degenerate(rows, ["feature", "date"], least_iqr=8.0).select("feature", day(), "degenerate")


DAILY = "d AS (SELECT o_orderpriority AS feature, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1000 AS value FROM orders GROUP BY 1, 2)"


def daily_orders(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feature"), F.to_date("o_orderdate").alias("date"))
    return by.agg((F.sum("o_totalprice") / 1000).alias("value"))


def every_day(train_days: int) -> str:
    """SQL of :func:`full_days` of the orders."""
    return f"f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(min(o_orderdate) AS DATE) + {train_days} FROM orders))"


def full_days(rows, train_days: int):
    """Forecast days: every date of ``rows`` that has a whole window behind it."""
    first = rows.agg(F.date_add(F.min("date"), train_days).alias("_first"))
    return rows.select(F.col("date").alias("day")).distinct().join(first, F.col("day") >= F.col("_first")).drop("_first")


@query(f"""WITH {DAILY}, {every_day(28)} SELECT CAST(f.day AS VARCHAR) AS day, feature, count(*) AS n, round(avg(value) + 1e-7, 4) AS mean, round(min(value) + 1e-7, 4) AS low, round(max(value) + 1e-7, 4) AS high
FROM f JOIN d ON d.date BETWEEN f.day - 28 AND f.day - 1 GROUP BY 1, 2""")
def rolling_window_stats(spark, sf_dir):
    """Facts of the 28 days before each day with a whole window."""
    rows = daily_orders(spark, sf_dir)
    facts = {"n": F.count("value"), "mean": F.avg("value"), "low": F.min("value"), "high": F.max("value")}
    out = panel.rolling_facts(full_days(rows, 28), rows, 28, ["feature"], facts)
    return out.select(day("day"), "feature", "n", *[steady(F.col(c), c) for c in ("mean", "low", "high")])


_FAMILY = "CASE feature WHEN '1-URGENT' THEN 'price' WHEN '2-HIGH' THEN 'wind' WHEN '3-MEDIUM' THEN 'ssrd' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'calendar' END"


def family_of(df):
    kinds = {"1-URGENT": "price", "2-HIGH": "wind", "3-MEDIUM": "ssrd", "4-NOT SPECIFIED": "other"}
    out = F.lit("calendar")
    for k, v in kinds.items():
        out = F.when(F.col("feature") == k, v).otherwise(out)
    return df.withColumn("family", out)


def folds(rows, scale):
    rows, days = family_of(rows), full_days(rows, 56)
    return scale(panel.rolling_window(days, rows, 56), scaling.fold_params(days, rows, 56), ["day"]).select(day("day"), day(), "feature", r6("value"))


_FOLD = f"""{DAILY}, {every_day(56)}, tr AS (SELECT f.day AS day, {_FAMILY} AS family, feature, d.date AS date, value FROM f JOIN d ON d.date BETWEEN f.day - 56 AND f.day - 1),
a AS (SELECT day, family, feature, median(value) AS center, min(value) AS low, max(value) - min(value) AS span, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS positive FROM tr GROUP BY 1, 2, 3),
b AS (SELECT tr.day AS day, tr.feature AS feature, median(abs(value - center)) / {C.MAD_TO_SD} AS scale FROM tr JOIN a ON a.day = tr.day AND a.feature = tr.feature GROUP BY 1, 2),
p AS (SELECT a.*, CASE WHEN scale > 1e-12 THEN scale ELSE 1 END AS scale, family = 'ssrd' AND (span < 20 OR positive < 0.5) AS flat FROM a JOIN b ON b.day = a.day AND b.feature = a.feature)"""


@query(f"""WITH {_FOLD} SELECT CAST(tr.day AS VARCHAR) AS day, CAST(tr.date AS VARCHAR) AS date, tr.feature AS feature, round(CASE WHEN flat THEN 0 WHEN tr.family = 'price' THEN asinh((value - center) / scale)
  WHEN tr.family = 'wind' THEN (value - center) / scale WHEN tr.family = 'calendar' THEN value WHEN span > 1e-12 THEN (value - low) / span ELSE value - low END, 6) AS value
FROM tr JOIN p ON p.day = tr.day AND p.feature = tr.feature""")
def fold_scaling(spark, sf_dir):
    """Training folds of every day with a whole window, scaled by family for point models."""
    return folds(daily_orders(spark, sf_dir), scaling.scale_fold)


@query(f"""WITH {_FOLD} SELECT CAST(tr.day AS VARCHAR) AS day, CAST(tr.date AS VARCHAR) AS date, tr.feature AS feature, round(CASE WHEN flat THEN 0 WHEN tr.family = 'calendar' THEN value
  WHEN span > 1e-12 THEN (value - low) / span ELSE 0 END, 6) AS value FROM tr JOIN p ON p.day = tr.day AND p.feature = tr.feature""")
def anc_fold_scaling(spark, sf_dir):
    """The same, scaled for contribution analysis."""
    return folds(daily_orders(spark, sf_dir), scaling.scale_fold_anc)


also("daily", "rolling_window_stats", "fold_scaling", "anc_fold_scaling")


@query("""SELECT l_orderkey, l_linenumber, round(1.5 + 0.2 * l_quantity + 0.001 * l_extendedprice - 3.0 * l_discount + 2.0 * l_tax, 6) AS y_hat FROM lineitem""")
def linear_predict(spark, sf_dir):
    """A linear prediction from arrays."""
    x = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    beta = F.array(*[F.lit(b) for b in (0.2, 0.001, -3.0, 2.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(forecast.linear_prediction(x, beta, F.lit(1.5)), "y_hat"))


@query("""WITH r AS (SELECT l_returnflag AS g, (l_discount - 0.05) * 10 AS r, l_tax * 10 AS y FROM lineitem), m AS (SELECT g, avg(cosh(r)) AS c, avg(sinh(r)) AS s FROM r GROUP BY 1)
SELECT g, round(y, 4) AS y, count(*) AS n, round(avg(5 + 2 * (sinh(y) * c + cosh(y) * s)), 6) AS y_pred FROM r JOIN m USING (g) GROUP BY 1, 2""")
def bias_corrected_inverse(spark, sf_dir):
    """Back-transformed predictions with the mean over residuals."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), ((F.col("l_discount") - 0.05) * 10).alias("r"), (F.col("l_tax") * 10).alias("y"))
    means = rows.groupBy("g").agg(F.avg(F.cosh("r")).alias("c"), F.avg(F.sinh("r")).alias("s"))
    pred = forecast.bias_corrected("y", "c", "s", F.lit(5.0), F.lit(2.0))
    return rows.join(means, "g").groupBy("g", F.round("y", 4).alias("y")).agg(F.count("*").alias("n"), F.round(F.avg(pred), 6).alias("y_pred"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), y AS (SELECT date, year(date) AS y FROM d),
e AS (SELECT date, y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e),
i AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS i FROM h), n AS (SELECT *, h + i - 7 * ((a + 11 * h + 22 * i) // 451) + 114 AS n FROM i),
x AS (SELECT *, date_diff('day', make_date(y, n // 31, n % 31 + 1), date) AS after FROM n)
SELECT CAST(date AS VARCHAR) AS date, CAST(date >= DATE '1998-01-01' AS INTEGER) AS is_15min_market, """ + ", ".join(f"CAST(isodow(date) = {k + 1} AS INTEGER) AS weekday_{k}" for k in range(7)) + """,
CAST(strftime(date, '%m-%d') IN ('01-01', '05-01', '10-03', '12-25', '12-26') OR after IN (-2, 1, 39, 50) AS INTEGER) AS is_holiday FROM x""")
def calendar_features(spark, sf_dir):
    """Regime, weekday and holiday flags of the days with orders."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return features.calendar_features(days, "1998-01-01").withColumn("date", F.col("date").cast("string"))


NAMES = ["exaa_d0_mtu_07", "price_d1_mtu_12", "load_d0_mtu_03", "wind_speed_cluster_4_h11", "ssrd_cluster_2_h09", "sw_dir_cluster_3_mtu40", "weekday_3", "is_holiday", "is_15min_market", "price_d7_mtu_00", "t2m_cluster_0_h01"]
_NAME = "CASE CAST(l_partkey % 11 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
_GROUP = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(feature, '{p}')" for p in parts) + f" THEN '{label}'" for label, parts in C.GROUP_RULES) + " ELSE 'Other' END"
_CONTRIB = f"""c AS (SELECT {_NAME} AS feature, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_linenumber AS INTEGER) AS mtu, l_quantity * (l_discount - 0.05) AS contribution FROM lineitem)"""
_CLUSTER = r"""CASE WHEN regexp_matches(feature, 'wind_speed_cluster_\d+_h\d+') THEN 'Wind Cluster ' || regexp_extract(feature, 'cluster_(\d+)_', 1)
  WHEN regexp_matches(feature, '(?:ssrd|sw_dir|sw_dif)\w*cluster_(\d+)_(?:h|mtu)\d+') THEN 'Solar Cluster ' || regexp_extract(feature, 'cluster_(\d+)_', 1) ELSE 'Other' END"""


def contributions(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("l_partkey") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        name.alias("feature"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_linenumber").alias("mtu"), (F.col("l_quantity") * (F.col("l_discount") - 0.05)).alias("contribution")
    )


@query(f"WITH {_CONTRIB} SELECT feature, {_GROUP} AS feature_group, {_CLUSTER} AS cluster_group, coalesce(TRY_CAST(nullif(regexp_extract({_CLUSTER}, 'Wind Cluster (\\d+)', 1), '') AS INTEGER), -1) AS wind_id, count(*) AS n FROM c GROUP BY ALL")
def feature_groups(spark, sf_dir):
    """Groups and clusters of feature names."""
    rows = contributions(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"))
    return rows.select("feature", C.feature_group("feature").alias("feature_group"), C.feature_cluster("feature").alias("cluster_group"), F.coalesce(C.id_of_label(C.feature_cluster("feature"), "Wind Cluster"), F.lit(-1)).alias("wind_id"), "n")


@query(f"""WITH {_CONTRIB}, s AS (SELECT month, mtu, {_GROUP} AS feature_group, sum(contribution) AS c FROM c GROUP BY 1, 2, 3)
SELECT feature_group, round(avg(abs(c)), 5) AS anc FROM s GROUP BY 1""")
def contribution_anc(spark, sf_dir):
    """Mean absolute contribution by group."""
    return importance.anc_by_group(contributions(spark, sf_dir), [], ["month", "mtu"]).select("feature_group", F.round("anc", 5).alias("anc"))


@query(f"""WITH {_CONTRIB}, s AS (SELECT month, mtu, {_CLUSTER} AS cluster_group, sum(contribution) AS c FROM c WHERE mtu BETWEEN 2 AND 5 GROUP BY 1, 2, 3)
SELECT cluster_group, round(avg(abs(c)), 5) AS anc FROM s WHERE cluster_group <> 'Other' GROUP BY 1""")
def contribution_anc_clusters(spark, sf_dir):
    """The same by cluster within a window of slots."""
    return importance.anc_by_cluster(contributions(spark, sf_dir), [], ["month", "mtu"], (2, 5)).select("cluster_group", F.round("anc", 5).alias("anc"))


@query(f"""WITH {DAILY}, k AS (SELECT date, count(*) AS n FROM d WHERE value > 100 GROUP BY 1), u AS (SELECT DISTINCT date FROM d), f AS (SELECT DISTINCT feature FROM d),
x AS (SELECT u.date AS date, f.feature AS feature, d.value AS value FROM u CROSS JOIN f LEFT JOIN d ON d.date = u.date AND d.feature = f.feature AND d.value > 100)
SELECT CAST(date AS VARCHAR) AS date, string_agg(feature, ',' ORDER BY feature) AS null_features FROM x WHERE value IS NULL GROUP BY 1""")
def incomplete_cases(spark, sf_dir):
    """Days that miss a feature, and which."""
    rows = daily_orders(spark, sf_dir)
    skeleton = rows.select("date").distinct().join(rows.select("feature").distinct(), how="cross")
    found = features.incomplete_days(skeleton.join(rows.where("value > 100"), ["date", "feature"], "left"))
    return found.select(day(), F.array_join("null_features", ",").alias("null_features"))


@query(f"""WITH {DAILY}, l AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT date FROM d WHERE feature = '1-URGENT' AND value > 50)
SELECT CAST(d.date AS VARCHAR) AS date, count(*) AS n_features, round(sum(value), 8) AS total FROM d WHERE date IN (SELECT date FROM l) AND date IN (SELECT date FROM b) GROUP BY 1""")
def feature_assembly(spark, sf_dir):
    """The blocks' rows on the days that every block has."""
    rows = daily_orders(spark, sf_dir).withColumn("family", F.lit("price"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").cast("double").alias("value"))
    urgent = rows.where("feature = '1-URGENT' and value > 50").withColumn("family", F.lit("urgent"))
    all_rows = features.assemble([rows, shipped.select(F.lit("n").alias("feature"), "date", "value", F.lit("load").alias("family")), urgent])
    return all_rows.where("family = 'price'").groupBy(day()).agg(F.count("*").alias("n_features"), F.round(F.sum("value"), 8).alias("total"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, event_type AS var, avg(value) AS value FROM events GROUP BY 1, 2, 3)
SELECT CAST(date AS VARCHAR) AS date, CAST(hour AS INTEGER) AS hour, round(max(value) FILTER (WHERE var = 'click'), 6) AS u, round(max(value) FILTER (WHERE var = 'view'), 6) AS v,
  round(sqrt(pow(max(value) FILTER (WHERE var = 'click'), 2) + pow(max(value) FILTER (WHERE var = 'view'), 2)), 6) AS speed FROM d GROUP BY 1, 2
HAVING max(value) FILTER (WHERE var = 'click') IS NOT NULL AND max(value) FILTER (WHERE var = 'view') IS NOT NULL""")
def wind_speed(spark, sf_dir):
    """Two components joined by time, and their speed."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("var")).agg(F.avg("value").alias("value"))
    wide = panel.join_variables(rows, "t", ["click", "view"])
    return wide.select(F.to_date("t").cast("string").alias("date"), F.hour("t").alias("hour"), r6("click", "u"), r6("view", "v"), r6(C.wind_speed("click", "view"), "speed"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS t, o_orderstatus AS var, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT CAST(t AS VARCHAR) AS t, round(max(value) FILTER (WHERE var = 'F'), 4) AS f, round(max(value) FILTER (WHERE var = 'O'), 4) AS o, round(max(value) FILTER (WHERE var = 'P'), 4) AS p FROM d GROUP BY 1""")
def outer_merge(spark, sf_dir):
    """Variables merged by any time that one of them has."""
    rows = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("t"), F.col("o_orderstatus").alias("var")).agg(F.avg("o_totalprice").alias("value"))
    return panel.join_variables(rows, "t", ["F", "O", "P"], "full").select(day("t"), *[F.round(x, 4).alias(x.lower()) for x in "FOP"])


@query("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT 'missing' AS kind, CAST(date AS VARCHAR) AS date FROM (SELECT * FROM o EXCEPT SELECT * FROM l) UNION ALL SELECT 'extra', CAST(date AS VARCHAR) FROM (SELECT * FROM l EXCEPT SELECT * FROM o)""")
def set_differences(spark, sf_dir):
    """Days with orders but no shipping, and the other way round."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    s = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return panel.differences(o, s, ["date"]).select("kind", day())


@query("""SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1""")
def membership(spark, sf_dir):
    """Rows with keys in one set and not in another."""
    orders = table(spark, sf_dir, "orders")
    kept = panel.only(orders.withColumn("c_custkey", F.col("o_custkey")), table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"])
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return panel.only(kept, large, ["o_orderkey"], inside=False).groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT 'flag' AS kind, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def union_distinct(spark, sf_dir):
    """Distinct values of several columns with their counts."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return panel.union_all([part(lines, "flag", "l_returnflag"), part(lines, "status", "l_linestatus"), part(orders, "priority", "o_orderpriority")])


GRID_POINTS = "e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat, label FROM embeddings)"
CENTERS = "c AS (SELECT label AS cluster_id, avg(lon) AS lon, avg(lat) AS lat FROM e GROUP BY 1)"


def points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.element_at("embedding", 1).cast("double").alias("lon"), F.element_at("embedding", 2).cast("double").alias("lat"), "label")


@query(f"""WITH {GRID_POINTS}, {CENTERS}, d AS (SELECT vec_id, cluster_id, pow(e.lon - c.lon, 2) + pow(e.lat - c.lat, 2) AS d FROM e CROSS JOIN c)
SELECT vec_id, arg_min(cluster_id, d) AS cluster_id, round(min(d), 8) AS dist2 FROM d GROUP BY 1""")
def nearest_centroid(spark, sf_dir):
    """The cluster of the nearest mapped point."""
    p = points(spark, sf_dir)
    mapped = p.groupBy(F.col("label").alias("cluster_id")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return spatial.nearest_cluster(p, mapped, "vec_id", 0.05).select("vec_id", "cluster_id", F.round("dist2", 8).alias("dist2"))


@query(f"""WITH {GRID_POINTS}, f AS (SELECT e.label AS cluster_id, CAST(v.ts AS DATE) AS date, v.value AS value FROM events AS v JOIN e ON e.vec_id = v.user_id)
SELECT CAST(date AS VARCHAR) AS date, cluster_id, round(avg(value), 6) AS value FROM f GROUP BY 1, 2""")
def cluster_mean(spark, sf_dir):
    """Mean by day and cluster over the cluster's points."""
    field = table(spark, sf_dir, "events").select(F.col("user_id").alias("vec_id"), F.to_date("ts").alias("date"), "value")
    mapping = points(spark, sf_dir).select("vec_id", F.col("label").alias("cluster_id"))
    means = spatial.cluster_means(field, mapping, ["vec_id"], ["date"]).where("value is not null")
    return means.select(day(), "cluster_id", r6("value"))


@query(f"""WITH {GRID_POINTS}, c AS (SELECT label, avg(lat) AS lat, count(*) AS n FROM e GROUP BY 1) SELECT label, CAST(row_number() OVER (ORDER BY lat DESC, label) - 1 AS INTEGER) AS cluster_id, n AS n_points FROM c""")
def cluster_renumber(spark, sf_dir):
    """Cluster ids from north to south, and sizes."""
    p = spatial.renumber_north_to_south(points(spark, sf_dir), "label")
    return p.groupBy("label", "cluster_id").agg(F.count("*").alias("n_points"))


@query(f"""WITH {GRID_POINTS}, x AS (SELECT DISTINCT round(lon, 2) AS v FROM e), y AS (SELECT DISTINCT round(lat, 2) AS v FROM e), gx AS (SELECT median(g) AS g FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM x)), gy AS (SELECT median(g) AS g FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM y))
SELECT vec_id, round(round(lon, 2) - gx.g / 2, 6) AS lon_min, round(round(lon, 2) + gx.g / 2, 6) AS lon_max, round(round(lat, 2) - gy.g / 2, 6) AS lat_min, round(round(lat, 2) + gy.g / 2, 6) AS lat_max FROM e CROSS JOIN gx CROSS JOIN gy""")
def grid_spacing(spark, sf_dir):
    """Cell boxes by the median spacing of coordinates."""
    p = points(spark, sf_dir).withColumn("lon", F.round("lon", 2)).withColumn("lat", F.round("lat", 2))
    gaps = [selection.grid_spacing(p, axis).first()["gap"] for axis in ("lon", "lat")]
    return spatial.cell_boxes(p, *gaps).select("vec_id", *[r6(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


@query("""WITH f AS (SELECT event_type AS var, ts - INTERVAL 1 HOUR AS ts, coalesce(value, 0) / 3600 AS value FROM events) SELECT var, strftime(ts, '%Y-%m-%d %H:00') AS ts, count(*) AS n, round(sum(value), 8) AS value
FROM f WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 23:00:00' GROUP BY 1, 2""")
def flatten_axes(spark, sf_dir):
    """Run time and step as one axis of interval starts, energy as power."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("var"), F.col("ts").alias("time"), F.lit(None).cast("timestamp_ntz").alias("valid_time"), "value")
    out = spatial.flatten_steps(rows, "2024-01-03 00:00:00", "2024-01-25 23:00:00")
    return out.groupBy("var", F.date_format("ts", "yyyy-MM-dd HH:00").alias("ts")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 8).alias("value"))


@query("""WITH s AS (SELECT event_type AS cluster_id, CAST(ts AS DATE) AS run, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2, 3),
t AS (SELECT *, date_diff('microsecond', min(ts) OVER (PARTITION BY cluster_id, run), ts) / 1e6 AS t, count(*) OVER (PARTITION BY cluster_id, run) AS n FROM s),
d AS (SELECT *, t - lag(t) OVER w AS dt, value * t - lag(value * t) OVER w AS de FROM t WINDOW w AS (PARTITION BY cluster_id, run ORDER BY ts))
SELECT cluster_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(CASE WHEN n >= 2 THEN CASE WHEN dt IS NOT NULL AND dt <> 0 THEN greatest(0, de / dt) END ELSE value END, 6) AS value FROM d""")
def flux_deaccumulate(spark, sf_dir):
    """A running mean since midnight as flux."""
    rows = table(spark, sf_dir, "events").withColumn("ts", timegrid.floor_slot("ts", 60))
    s = rows.groupBy(F.col("event_type").alias("cluster_id"), F.to_date("ts").alias("run"), "ts").agg(F.avg("value").alias("value"))
    return spatial.mean_to_flux(s, ["cluster_id", "run"]).select("cluster_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), r6("value"))


@query(f"""WITH {GRID_POINTS}, s AS (SELECT label AS cluster_id, avg(lon * lon) AS anc FROM e GROUP BY 1) SELECT label AS cluster_id, count(*) AS n, round(max(anc), 8) AS anc FROM e JOIN s ON s.cluster_id = e.label GROUP BY 1""")
def attach_scores(spark, sf_dir):
    """Scores of one training length attached to every point of a cluster."""
    p = points(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    scores = p.groupBy("cluster_id").agg(F.avg(F.col("lon") * F.col("lon")).alias("anc")).withColumn("train_days", F.explode(F.array(F.lit(56), F.lit(112))))
    return spatial.attach(p, scores, 56).groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.max("anc"), 8).alias("anc"))


@query(f"""WITH {GRID_POINTS}, b AS (SELECT quantile_cont(lon, 0.25) AS x0, quantile_cont(lon, 0.75) AS x1, quantile_cont(lat, 0.25) AS y0, quantile_cont(lat, 0.75) AS y1 FROM e)
SELECT vec_id, lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 AS inside FROM e CROSS JOIN b""")
def region_mask(spark, sf_dir):
    """Points inside a polygon (a box of the quartiles), without buffer."""
    p = points(spark, sf_dir)
    x0, x1, y0, y1 = [v for c in ("lon", "lat") for v in selection.exact_quantiles(p, [], c, [0.25, 0.75]).first()["q"]]
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(corners, corners[1:])], "lon1 double, lat1 double, lon2 double, lat2 double")
    return spatial.region_mask(p, edges, 1e-9).select("vec_id", "inside")


@query(f"""WITH {GRID_POINTS}, c AS (SELECT avg(lon) AS x, avg(lat) AS y, stddev_pop(lat) AS r FROM e), k AS (SELECT vec_id, lon - x AS dx, lat - y AS dy, lat, r FROM e CROSS JOIN c),
d AS (SELECT vec_id, greatest(abs(dx) - r, 0) * cos(radians(lat)) AS ex, greatest(abs(dy) - r / 2, 0) AS ey FROM k)
SELECT vec_id, sqrt(ex * ex + ey * ey) * radians(1.0::DOUBLE) * {spatial.EARTH_KM} <= 25 AS inside FROM d""")
def region_buffer(spark, sf_dir):
    """Points within 25 km of a box that is outlined by a thousand edges a side."""
    p = points(spark, sf_dir)
    x, y, r = p.agg(F.avg("lon"), F.avg("lat"), F.stddev_pop("lat")).first()
    corners = [(x - r, y - r / 2), (x + r, y - r / 2), (x + r, y + r / 2), (x - r, y + r / 2), (x - r, y - r / 2)]
    sides = spark.createDataFrame([(*a, *b) for a, b in zip(corners, corners[1:])], "a0 double, b0 double, a1 double, b1 double")
    part = lambda c, i: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col("i") + i) / 1000
    edges = sides.join(spark.range(1000).withColumnRenamed("id", "i"), how="cross").select(part("a", 0).alias("lon1"), part("b", 0).alias("lat1"), part("a", 1).alias("lon2"), part("b", 1).alias("lat2"))
    return spatial.region_mask(p, edges, 25.0).select("vec_id", "inside")


@query()
def kmeans(spark, sf_dir):
    """k-means over two coordinates with ids from north to south."""
    return spatial.renumber_north_to_south(spatial.kmeans(points(spark, sf_dir), 5, ["lon", "lat"])).select("vec_id", "cluster_id")


def rolling_inputs(spark, sf_dir):
    """Long features and targets of daily orders: lags of every priority and calendar flags."""
    found = daily_orders(spark, sf_dir)
    days = found.select("date").distinct().join(found.select("feature").distinct(), how="cross")  # five names
    daily = days.join(found, ["date", "feature"], "left").fillna(0.0, ["value"])
    order = Window.partitionBy("feature").orderBy("date")
    lags = daily.withColumns({f"price_d{n}": F.lag("value", n).over(order) for n in (1, 2, 7)}).unpivot(["date", "feature"], [f"price_d{n}" for n in (1, 2, 7)], "lag", "v")
    prices = lags.select("date", F.lit("price").alias("family"), F.concat_ws("_", "lag", "feature").alias("feature"), F.lit(0).alias("slot"), F.col("v").alias("value"))
    flags = features.as_long(features.calendar_features(daily.select("date").distinct(), "1998-01-01"), "calendar")
    x = stored(features.complete_cases(features.assemble([prices, flags])), "features")  # read by windows, scales and tests
    target = daily.select("date", (F.substring("feature", 1, 1).cast("int") - 1).alias("mtu"), "value")
    return x, target, full_days(x, 56)


@query()
def lasso_forecast(spark, sf_dir):
    """A sparse model for each day with a whole window and each priority over the 56 days before."""
    x, target, days = rolling_inputs(spark, sf_dir)
    out = forecast.rolling_point_forecast(x, target, days, 56)
    named = [F.array_join("nonzero_cols", ",").alias("nonzero_cols"), F.array_join(F.transform("nonzero_vals", lambda v: F.round(v, 6)), ",").alias("nonzero_vals")]
    return out.select(day("day"), "mtu", F.round("y_pred", 4).alias("y_pred"), r6("alpha"), r6("intercept"), "n_nonzero", *named, "runtime_seconds")


#: The features and targets of :func:`rolling_inputs`: x (date, feature, value) and t (date, mtu, value), with the forecast days f.
_ROLLING = f"""{DAILY}, u AS (SELECT DISTINCT date FROM d), g AS (SELECT u.date AS date, n.feature AS feature, coalesce(d.value, 0) AS value FROM u CROSS JOIN (SELECT DISTINCT feature FROM d) AS n
  LEFT JOIN d ON d.date = u.date AND d.feature = n.feature),
lagged AS (SELECT date, feature, lag(value, 1) OVER w AS price_d1, lag(value, 2) OVER w AS price_d2, lag(value, 7) OVER w AS price_d7 FROM g WINDOW w AS (PARTITION BY feature ORDER BY date)),
wide AS (UNPIVOT lagged ON price_d1, price_d2, price_d7 INTO NAME lag VALUE value),
whole AS (SELECT date FROM wide GROUP BY 1 HAVING count(*) = 3 * (SELECT count(DISTINCT feature) FROM d)),
flags AS (UNPIVOT (SELECT CAST(date AS DATE) AS date, * EXCLUDE (date) FROM ({SQL["calendar_features"]})) ON * EXCLUDE (date) INTO NAME feature VALUE value),
x AS (SELECT date, 'price' AS family, lag || '_' || feature AS feature, value FROM wide JOIN whole USING (date) UNION ALL SELECT date, 'calendar', feature, CAST(value AS DOUBLE) FROM flags JOIN whole USING (date)),
t AS (SELECT date, CAST(substr(feature, 1, 1) AS INTEGER) - 1 AS mtu, value FROM g), f AS (SELECT DISTINCT date AS day FROM x WHERE date >= (SELECT min(date) + 56 FROM x)),
tr AS (SELECT f.day AS day, x.* FROM f JOIN x ON x.date BETWEEN f.day - 56 AND f.day - 1), past AS (SELECT f.day AS day, t.* FROM f JOIN t ON t.date BETWEEN f.day - 56 AND f.day - 1)"""
#: The largest penalty of each fit from the scaled features sx (day, date, feature, value) and targets sy (day, date, mtu, y), and what every optimum fulfils.
_CERTIFIED = """SELECT CAST(day AS VARCHAR) AS day, mtu, max(n) AS n, count(*) AS n_features, round(max(abs(c0)), 4) AS alpha_max, true AS active_hold, true AS idle_hold, true AS centred, true AS on_grid, true AS predicted
FROM (SELECT day, mtu, feature, count(*) AS n, avg(value * y) - avg(value) * avg(y) AS c0 FROM sx JOIN sy USING (day, date) GROUP BY day, mtu, feature) GROUP BY day, mtu"""


def certified(x, y, fits=None):
    """Every fit (by default those from these rows) with its facts and whether it is optimal to 1e-8 of the largest penalty, as sums over its rows say."""
    x, y = stored(x, "fold-features"), stored(y, "fold-targets")
    found = forecast.fit_certificates(x, y, stored(fits or forecast.rolling_fit(x, y), "fits"))
    small = {"active_hold": "active_gap", "idle_hold": "idle_excess", "centred": "mean_gap", "predicted": "forecast_gap"}
    holds = [(F.col(gap) <= 1e-8 * (1 + F.col("alpha_max"))).alias(name) for name, gap in small.items()]
    return found.select(day("day"), "mtu", "n", "n_features", F.round("alpha_max", 4).alias("alpha_max"), *holds, (F.col("grid_gap") <= 1e-6).alias("on_grid"))


@query(f"""WITH {_ROLLING}, c AS (SELECT day, feature, median(value) AS center FROM tr WHERE family = 'price' GROUP BY 1, 2),
s AS (SELECT tr.day AS day, feature, any_value(center) AS center, median(abs(value - center)) / {C.MAD_TO_SD} AS scale FROM tr JOIN c USING (day, feature) GROUP BY 1, 2),
sx AS (SELECT tr.day AS day, date, feature, CASE WHEN center IS NULL THEN value ELSE asinh((value - center) / CASE WHEN scale > 1e-12 THEN scale ELSE 1 END) END AS value FROM tr LEFT JOIN s USING (day, feature)),
cy AS (SELECT day, mtu, median(value) AS center FROM past GROUP BY 1, 2),
ty AS (SELECT past.day AS day, past.mtu AS mtu, any_value(center) AS center, median(abs(value - center)) / {C.MAD_TO_SD} AS scale FROM past JOIN cy USING (day, mtu) GROUP BY 1, 2),
sy AS (SELECT past.day AS day, date, mtu, asinh((value - center) / CASE WHEN scale > 1e-12 THEN scale ELSE 1 END) AS y FROM past JOIN ty USING (day, mtu)) {_CERTIFIED}""")
def lasso_certificates(spark, sf_dir):
    """Optimality of every fit behind :func:`lasso_forecast`, from its coefficients and rows."""
    x, target, days = rolling_inputs(spark, sf_dir)
    return certified(*forecast.point_inputs(x, target, days, 56)[:2])


@query(f"""WITH {_ROLLING}, b AS (SELECT day, feature, min(value) AS low, max(value) - min(value) AS span FROM tr WHERE family = 'price' GROUP BY 1, 2),
sx AS (SELECT tr.day AS day, date, feature, CASE WHEN span IS NULL THEN value WHEN span > 1e-12 THEN (value - low) / span ELSE 0 END AS value FROM tr LEFT JOIN b USING (day, feature)),
sy AS (SELECT day, date, mtu, value AS y FROM past) {_CERTIFIED}""")
def contribution_certificates(spark, sf_dir):
    """The same for the fits behind :func:`lasso_contributions`."""
    x, target, days = rolling_inputs(spark, sf_dir)
    fits, _ = forecast.contribution_fits(x, target, days, 56)
    return certified(*forecast.contribution_inputs(x, target, days, 56)[:2], fits)


@query(f"""WITH d AS (SELECT l_returnflag AS feature, CAST(l_shipdate AS DATE) AS date, avg(l_discount * 500 - 5) AS value FROM lineitem GROUP BY 1, 2), k AS (SELECT DISTINCT date FROM d),
f AS (SELECT date AS day FROM k WHERE date >= (SELECT min(date) + 56 FROM k)),
w AS (SELECT f.day AS day, feature FROM f JOIN d ON d.date BETWEEN f.day - 56 AND f.day - 1 GROUP BY 1, 2 HAVING max(value) - min(value) < 20 OR avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) < 0.5)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n_degenerate, string_agg(feature, ',' ORDER BY feature) AS degenerate_cols FROM w GROUP BY 1""")
def degenerate_columns(spark, sf_dir):
    """Solar features that the 56 days before a day leave flat."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("feature"), F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_discount") * 500 - 5).alias("value"))
    rows = rows.withColumn("family", F.lit("ssrd"))
    out = forecast.degenerate_columns(rows, full_days(rows, 56), 56)
    return out.select(day("day"), "n_degenerate", F.array_join("degenerate_cols", ",").alias("degenerate_cols"))


@query()
def lasso_contributions(spark, sf_dir):
    """Mean absolute contributions of feature groups of these models."""
    x, target, days = rolling_inputs(spark, sf_dir)
    rows = forecast.rolling_contributions(x, target, days, 56)
    return importance.anc_by_group(rows, [], ["day", "mtu"]).select("feature_group", F.round("anc", 4).alias("anc"))


@query()
def quantile_forecast(spark, sf_dir):
    """Smoothed quantile regressions of every slot of every day on its last two values, sorted by level; NULL where too few days lie behind."""
    w = Window.partitionBy("series", "mtu").orderBy("date")
    p = slots(spark, sf_dir).withColumn("pair", F.array("value", F.lag("value", 1).over(w)))
    grid = profile.slot_skeleton(p, ["series"])
    last = F.coalesce(F.last("pair", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.array(F.lit(None).cast("double"), F.lit(None).cast("double")))
    panel_rows = stored(grid.select("date", "series", "mtu", F.col("value").alias("y_true"), last.alias("x")), "lags")
    days = panel_rows.select(F.col("date").alias("day")).distinct()
    out = forecast.rolling_quantile_forecast(panel_rows, days, [0.1, 0.25, 0.5, 0.75, 0.9], 14, ["series"])
    q = C.sorted_quantiles("q")
    return out.select(day("day"), "series", "mtu", *[F.round(F.element_at(q, i + 1), 4).alias(f"q{i}") for i in range(5)])
