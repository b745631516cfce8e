"""Queries that score forecasts: naive forecasts of events and orders, quantiles of lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import metrics, panel, profile, selection, spatial, tests_stat, validate
from ..sources.shared import stored_by
from .grid_queries import PROFILE, slots
from .registry import SQL, also, day, query, r6, steady, table

MODELS = ["naive_d1", "naive_d7", "slot_mean"]
PANEL = f"""{PROFILE}, l AS (SELECT date, series, mtu, value AS y_true, lag(value, 1) OVER w AS naive_d1, lag(value, 7) OVER w AS naive_d7, avg(value) OVER (PARTITION BY series, mtu) AS slot_mean
  FROM p WINDOW w AS (PARTITION BY series, mtu ORDER BY date)),
panel AS (SELECT 'naive_d1' AS model, date, series, mtu, naive_d1 AS y_pred, y_true FROM l UNION ALL SELECT 'naive_d7', date, series, mtu, naive_d7, y_true FROM l
  UNION ALL SELECT 'slot_mean', date, series, mtu, slot_mean, y_true FROM l)"""


def naive_panel(spark, sf_dir):
    """Naive forecasts by lag and by slot mean, in long form."""
    p = profile.day_lag(slots(spark, sf_dir), ["series"], [1, 7])
    p = p.withColumn("slot_mean", F.avg("value").over(Window.partitionBy("series", "mtu")))
    models = [F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in (("naive_d1", "lag_1"), ("naive_d7", "lag_7"), ("slot_mean", "slot_mean"))]
    rows = p.select("date", "series", "mtu", F.col("value").alias("y_true"), F.explode(F.array(*models)).alias("m"))
    return rows.select("m.model", "date", "series", "mtu", "m.y_pred", "y_true")


#: The panel of the tests: each model of a series has each (date, slot) once.
TESTED = f"{PANEL}, t AS (SELECT series, model, date, mtu, y_pred, y_true FROM panel WHERE y_pred IS NOT NULL)"


METRICS = """round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 6) AS rmse, round(avg(y_pred - y_true), 6) + 0.0 AS bias,
  count(y_pred - y_true) AS n_obs, count(*) - count(y_pred - y_true) AS n_inf_nan"""
ROUNDED = [r for r in ("mae", "rmse", "bias")]


@query(f"""WITH {PANEL} SELECT model, CASE WHEN grouping(week) = 1 THEN 'full' ELSE CAST(week AS VARCHAR) END AS period, {METRICS}
FROM (SELECT *, weekofyear(date) AS week FROM panel WHERE y_pred IS NOT NULL) GROUP BY GROUPING SETS ((model), (model, week))""")
def naive_metrics_grouping_sets(spark, sf_dir):
    """How good are seasonal-naive forecasts, overall and by week?"""
    rows = naive_panel(spark, sf_dir).where("y_pred is not null").withColumn("week", F.weekofyear("date"))
    out = metrics.metrics_by_period(rows, ["model"], "week")
    return out.select("model", "period", *[(F.round(c, 6) + 0.0).alias(c) for c in ROUNDED], "n_obs", "n_inf_nan")


@query(f"""WITH d AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS y_true FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(y_true, 7) OVER (PARTITION BY series ORDER BY date) AS y_pred, strftime(date, '%Y-%m') AS month FROM d)
SELECT series, CASE WHEN grouping(month) = 1 THEN 'full' ELSE month END AS period, {METRICS.replace(', 6)', ' + 1e-7, 4)')} FROM l GROUP BY GROUPING SETS ((series), (series, month))""")
def monthly_metrics(spark, sf_dir):
    """Lag-7 forecasts of daily orders, full and by month; days without forecast are counted."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("y_true"))
    rows = days.withColumn("y_pred", F.lag("y_true", 7).over(Window.partitionBy("series").orderBy("date"))).withColumn("month", F.date_format("date", "yyyy-MM"))
    out = metrics.metrics_by_period(rows, ["series"], "month")
    return out.select("series", "period", *[steady(F.col(c), c) for c in ROUNDED], "n_obs", "n_inf_nan")


@query(f"""WITH {PANEL} SELECT model, series, {METRICS}, CAST(row_number() OVER (PARTITION BY series ORDER BY round(avg(abs(y_pred - y_true)), 6), model) AS INTEGER) AS rank
FROM panel WHERE y_pred IS NOT NULL GROUP BY model, series""")
def point_metrics_ranked(spark, sf_dir):
    """Metrics of each model and series with the rank of the model."""
    out = metrics.point_metrics(naive_panel(spark, sf_dir).where("y_pred is not null"), ["model", "series"])
    out = out.select("model", "series", *[(F.round(c, 6) + 0.0).alias(c) for c in ROUNDED], "n_obs", "n_inf_nan")
    return panel.ranked(out, ["mae", "model"], ["series"])


TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]
#: Empirical quantiles by flag and month are the forecast of the next month's prices.
QUANTILES = """m AS (SELECT l_returnflag AS model, date_trunc('month', l_shipdate) AS month, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS y FROM lineitem),
qs AS (SELECT model, month, [round(v, 6) for v in quantile_cont(y, [0.1, 0.25, 0.5, 0.75, 0.9])] AS q FROM m GROUP BY 1, 2),
j AS (SELECT m.model AS model, m.id AS id, m.date AS date, y, q FROM m JOIN qs ON qs.model = m.model AND date_trunc('month', m.month - INTERVAL 1 DAY) = qs.month),
u AS (SELECT model, id, date, y, q, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS tau, unnest(q) AS qv FROM j)"""
PINBALL = "greatest(tau * (y - qv), (tau - 1) * (y - qv))"


def quantile_rows(spark, sf_dir):
    """model, date, id, y, q (array): last month's quantiles for each line."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("y"),
    )
    qs = selection.exact_quantiles(rows, ["model", "month"], "y", TAUS)
    qs = qs.select("model", F.add_months("month", 1).alias("month"), F.transform("q", lambda v: F.round(v, 6)).alias("q"))  # the same number whatever the order of the sum
    return rows.join(spatial.small(qs), ["model", "month"])


@query(f"""WITH {QUANTILES}, s AS (SELECT model, date, id, any_value(y) AS y, any_value(q) AS q, avg({PINBALL}) AS aps FROM u GROUP BY 1, 2, 3),
d AS (SELECT model, CAST(date AS VARCHAR) AS period, avg(abs(y - q[3])) AS mae_median, avg(CASE WHEN y BETWEEN q[2] AND q[4] THEN 1 ELSE 0 END) AS coverage_inner,
  avg(CASE WHEN y BETWEEN q[1] AND q[5] THEN 1 ELSE 0 END) AS coverage_outer, avg(aps) AS aps FROM s GROUP BY 1, 2),
a AS (SELECT * FROM d UNION ALL SELECT model, 'mean', avg(mae_median), avg(coverage_inner), avg(coverage_outer), avg(aps) FROM d GROUP BY model)
SELECT model, period, round(mae_median, 8) AS mae_median, round(coverage_inner, 6) AS coverage_inner, round(coverage_outer, 6) AS coverage_outer, round(aps, 8) AS aps FROM a""")
def daily_scores_summary(spark, sf_dir):
    """Scores by day and their mean over the days."""
    out = metrics.daily_scores_of_arrays(quantile_rows(spark, sf_dir).withColumnRenamed("y", "y_true"), TAUS)
    return out.select("model", "period", F.round("mae_median", 8).alias("mae_median"), r6("coverage_inner"), r6("coverage_outer"), F.round("aps", 8).alias("aps"))


@query(f"""WITH {QUANTILES} SELECT model, count(*) AS n, round(avg(abs(y - q[3])), 4) AS mae_median,
  round(avg((q[5] - q[1]) + 2 / (1 - 0.8) * (greatest(q[1] - y, 0) + greatest(y - q[5], 0))), 3) AS winkler_80,
  round(avg((q[4] - q[2]) + 2 / (1 - 0.5) * (greatest(q[2] - y, 0) + greatest(y - q[4], 0))), 3) AS winkler_50 FROM j GROUP BY model""")
def interval_scores(spark, sf_dir):
    """Median error and interval scores."""
    q = lambda i: F.element_at("q", i)
    return quantile_rows(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - q(3))), 4).alias("mae_median"),
        F.round(F.avg(C.interval_score("y", q(1), q(5), 0.8)), 3).alias("winkler_80"), F.round(F.avg(C.interval_score("y", q(2), q(4), 0.5)), 3).alias("winkler_50"),
    )


@query(f"WITH {QUANTILES} SELECT model, tau, count(*) AS n, round(avg({PINBALL}), 4) AS pinball FROM u GROUP BY 1, 2")
def pinball_by_level(spark, sf_dir):
    """Mean pinball loss by level."""
    losses = [F.avg(C.pinball("y", F.element_at("q", i + 1), t)) for i, t in enumerate(TAUS)]
    each = F.array(*[F.struct(F.lit(t).alias("tau"), F.round(x, 4).alias("pinball")) for t, x in zip(TAUS, losses)])
    out = quantile_rows(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), each.alias("levels"))
    return out.select("model", "n", F.inline("levels"))


@query(f"WITH {QUANTILES} SELECT model, CAST(date AS VARCHAR) AS date, round(avg({PINBALL}), 8) AS aps FROM u GROUP BY 1, 2")
def aps_loss(spark, sf_dir):
    """Mean pinball loss over the levels by model and day."""
    rows = quantile_rows(spark, sf_dir).select("model", "date", metrics.mean_pinball("y", "q", TAUS).alias("aps"))
    return rows.groupBy("model", "date").agg(F.avg("aps").alias("aps")).select("model", day(), F.round("aps", 8).alias("aps"))


@query(f"""WITH {QUANTILES}, o AS (SELECT model, id, any_value(y) AS y, any_value(q) AS q FROM j GROUP BY 1, 2), i AS (SELECT * FROM (VALUES ('50', 2, 4, 0.5), ('80', 1, 5, 0.8)) AS t(interval, lo, hi, nominal))
SELECT model, interval, round(CAST(max(nominal) AS DOUBLE), 6) AS nominal, count(*) AS n, round(avg(CASE WHEN y BETWEEN q[lo] AND q[hi] THEN 1 ELSE 0 END), 6) AS coverage FROM o CROSS JOIN i GROUP BY 1, 2""")
def coverage_table(spark, sf_dir):
    """Empirical and nominal coverage."""
    out = metrics.coverage_of_arrays(quantile_rows(spark, sf_dir).withColumnRenamed("y", "y_true"), TAUS, [("50", 0.25, 0.75), ("80", 0.1, 0.9)])
    return out.select("model", "interval", r6("nominal"), "n", r6("coverage"))


_UNSORTED = "[l_quantity * 1000, l_extendedprice, l_discount * 500000, l_tax * 400000]"


def unsorted_quantiles(spark, sf_dir):
    q = F.array(F.col("l_quantity") * 1000, F.col("l_extendedprice"), F.col("l_discount") * 500000, F.col("l_tax") * 400000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"), q.alias("q"), F.col("l_shipdate").alias("ts"))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, list_sort({_UNSORTED}) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(q[1], 4) AS q1, round(q[2], 4) AS q2, round(q[3], 4) AS q3, round(q[4], 4) AS q4 FROM s""")
def quantile_sort(spark, sf_dir):
    """Crossing quantiles put in order row by row."""
    rows = unsorted_quantiles(spark, sf_dir).withColumn("q", C.sorted_quantiles("q"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.element_at("q", i), 4).alias(f"q{i}") for i in range(1, 5)])


@query(f"""WITH s AS (SELECT l_returnflag AS model, {_UNSORTED} AS q FROM lineitem)
SELECT model, count(*) FILTER (WHERE q[2] < q[1] OR q[3] < q[2] OR q[4] < q[3]) AS n_crossing, count(*) AS n_rows FROM s GROUP BY 1""")
def crossing_count(spark, sf_dir):
    """Rows whose quantiles cross."""
    return metrics.crossing_counts(unsorted_quantiles(spark, sf_dir), ["model"])


@query(f"""WITH s AS (SELECT l_returnflag AS model, l_shipdate AS ts, {_UNSORTED} AS q FROM lineitem)
SELECT model, count(*) AS n_bad, strftime(min(ts), '%Y-%m-%d') AS first_ts FROM s WHERE q[2] - q[1] < -1e-12 OR q[3] - q[2] < -1e-12 OR q[4] - q[3] < -1e-12 GROUP BY 1""")
def monotone_check(spark, sf_dir):
    """Violations of the order of quantiles and the first of them."""
    return validate.monotonicity_violations(unsorted_quantiles(spark, sf_dir), ["model"]).select("model", "n_bad", F.date_format("first_ts", "yyyy-MM-dd").alias("first_ts"))


def _gw(by: str, diff: str, mean: str = "avg(CASE WHEN b IS NOT NULL THEN d END)") -> str:
    return f"""x AS ({diff}), w AS (SELECT *, lag(d) OVER (PARTITION BY {by} ORDER BY date) AS b FROM x),
g AS (SELECT {by}, sum(CASE WHEN b IS NOT NULL THEN d END) AS s1, sum(d * b) AS s2, sum(CASE WHEN b IS NOT NULL THEN d * d END) AS m11, sum(d * d * b) AS m12, sum(d * d * b * b) AS m22, count(b) AS n, {mean} AS md FROM w GROUP BY {by}),
k AS (SELECT {by}, n, sign(md) * CASE WHEN abs(m11 * m22 - m12 * m12) > 1e-12 THEN (s1 * s1 * m22 - 2 * s1 * s2 * m12 + s2 * s2 * m11) / (m11 * m22 - m12 * m12) ELSE 0 END AS statistic FROM g)
SELECT {by}, n, round(statistic, 5) + 0.0 AS statistic, round(CASE WHEN statistic > 0 THEN exp(-statistic / 2) ELSE 1 END, 5) AS p_value FROM k"""


def series_losses(spark, sf_dir):
    return tests_stat.losses(naive_panel(spark, sf_dir).where("y_pred is not null"), keys=("series",))


@query(f"""WITH {TESTED}, e AS (SELECT series, model, date, avg(abs(y_pred - y_true)) AS loss FROM t GROUP BY 1, 2, 3), """
       + _gw("series, model_a, model_b", "SELECT a.series AS series, a.model AS model_a, b.model AS model_b, a.date AS date, a.loss - b.loss AS d FROM e AS a JOIN e AS b ON a.series = b.series AND a.date = b.date AND a.model <> b.model"))
def gw_matrix(spark, sf_dir):
    """Giacomini-White tests of all pairs of every series on daily mean losses."""
    diff = tests_stat.loss_differences(series_losses(spark, sf_dir), by=("series",))
    out = tests_stat.giacomini_white(diff, ["series", "model_a", "model_b"])
    return out.select("series", "model_a", "model_b", "n", (F.round("statistic", 5) + 0.0).alias("statistic"), F.round("p_value", 5).alias("p_value"))


@query(f"""WITH {TESTED}, e AS (SELECT series, model, date, mtu, abs(y_pred - y_true) AS loss FROM t), """
       + _gw("series, model_a, model_b, mtu", "SELECT a.series AS series, a.model AS model_a, b.model AS model_b, a.mtu AS mtu, a.date AS date, a.loss - b.loss AS d FROM e AS a JOIN e AS b ON a.series = b.series AND a.date = b.date AND a.mtu = b.mtu AND a.model < b.model", "avg(d)"))
def gw_per_slot(spark, sf_dir):
    """The same for every slot by itself, the sign over all days."""
    diff = tests_stat.loss_differences(series_losses(spark, sf_dir), by_slot=True, by=("series",)).where("model_a < model_b")
    out = tests_stat.giacomini_white(diff, ["series", "model_a", "model_b", "mtu"], "all")
    return out.select("series", "model_a", "model_b", "mtu", "n", (F.round("statistic", 5) + 0.0).alias("statistic"), F.round("p_value", 5).alias("p_value"))


@query(f"WITH g AS ({SQL['gw_matrix']}), k AS (SELECT * FROM (SELECT DISTINCT series FROM g) CROSS JOIN (SELECT unnest({MODELS}) AS model_a)) SELECT series, model_a, "
       + ", ".join(f"CASE WHEN model_a = '{m}' THEN 1.0 ELSE max(p_value) FILTER (WHERE model_b = '{m}') END AS {m}" for m in MODELS) + " FROM k LEFT JOIN g USING (series, model_a) GROUP BY series, model_a")
def gw_p_values(spark, sf_dir):
    """The square table of p-values of every series (O84); the same numbers as gw_matrix, pivoted."""
    tests = tests_stat.giacomini_white(tests_stat.loss_differences(series_losses(spark, sf_dir), by=("series",)), ["series", "model_a", "model_b"])
    return tests_stat.p_value_matrix(tests, MODELS, ("series",)).select("series", "model_a", *[F.round(m, 5).alias(m) for m in MODELS])


_HITS = f"""WITH {PROFILE}, b AS (SELECT series, mtu, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM p WHERE date < (SELECT min(date) + 15 FROM p) GROUP BY 1, 2),
h AS (SELECT p.series AS model, p.mtu + 1 AS mtu, CASE WHEN value BETWEEN lo AND hi THEN 1 ELSE 0 END AS hit FROM p JOIN b ON b.series = p.series AND b.mtu = p.mtu WHERE date >= (SELECT min(date) + 15 FROM p)),
c AS (SELECT model, mtu, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k FROM h GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN k > 0 AND k < n THEN -2 * ((n - k) * ln((1 - 0.8) / (1 - CAST(k AS DOUBLE) / n)) + k * ln(0.8 / (CAST(k AS DOUBLE) / n))) END AS lr FROM c)"""


def slot_hits(spark, sf_dir):
    """hit of all days after the table's first fifteen against the 80 % interval of those, slots 1..96."""
    p = slots(spark, sf_dir)
    p = p.join(F.broadcast(p.agg(F.date_add(F.min("date"), 15).alias("since"))), how="cross")  # one row
    bounds = p.where("date < since").groupBy("series", "mtu").agg(F.percentile("value", 0.1).alias("lo"), F.percentile("value", 0.9).alias("hi"))
    later = p.where("date >= since").join(bounds, ["series", "mtu"])
    return later.select(F.col("series").alias("model"), (F.col("mtu") + 1).alias("mtu"), C.covered("value", "lo", "hi").alias("hit"))


@query(_HITS + f" SELECT model, CAST(mtu AS INTEGER) AS mtu, n, k, round(lr, 6) + 0.0 AS lr, coalesce(lr <= {C.CHI2_1_95}, false) AS passed FROM r")
def kupiec_by_slot(spark, sf_dir):
    """Unconditional coverage by slot."""
    return tests_stat.kupiec(slot_hits(spark, sf_dir), ["model", "mtu"], F.lit(0.8)).select("model", "mtu", "n", "k", (F.round("lr", 6) + 0.0).alias("lr"), "passed")


_TERMS = f"list_reverse(range(1, {C.ERFC_TERMS + 1}))"
_ERFC = f"""CASE WHEN x < {C.ERFC_BORDER} THEN 1 - 2 * exp(-x * x) / 1.772453850905516 * x * list_reduce({_TERMS}, lambda s, n: 1 + s * 2 * x * x / (2 * n + 1), 1.0::DOUBLE)
  ELSE exp(-x * x) / 1.772453850905516 / list_reduce({_TERMS}, lambda s, n: x + n / 2.0::DOUBLE / s, x) END"""


@query(_HITS + f", t AS (SELECT *, sqrt(greatest(lr, 0) / 2) AS x FROM r) SELECT model, CAST(mtu AS INTEGER) AS mtu, n, k, round(coalesce(CASE WHEN lr IS NOT NULL THEN {_ERFC} END, 0.0::DOUBLE), 8) + 0.0::DOUBLE AS p_value FROM t")
def kupiec_p_values(spark, sf_dir):
    """The p-value of unconditional coverage by slot."""
    tests = tests_stat.with_p_value(tests_stat.kupiec(slot_hits(spark, sf_dir), ["model", "mtu"], F.lit(0.8)))
    return tests.select("model", "mtu", "n", "k", (F.round("p_value", 8) + 0.0).alias("p_value"))


@query(_HITS + f" SELECT model, count(*) FILTER (WHERE coalesce(lr <= {C.CHI2_1_95}, false)) AS n_passed, count(*) AS n_slots FROM r GROUP BY 1")
def kupiec_passed(spark, sf_dir):
    """How many slots pass."""
    return tests_stat.passed_slots(tests_stat.kupiec(slot_hits(spark, sf_dir), ["model", "mtu"], F.lit(0.8)), ["model"])


@query(f"""WITH {PANEL}, g AS (SELECT DISTINCT series, model, date, mtu FROM panel WHERE y_pred IS NOT NULL),
e AS (SELECT m.series AS series, m.model AS model, d.date AS date, CAST(u.mtu AS INTEGER) AS mtu FROM (SELECT DISTINCT series, model FROM g) AS m CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) AS d CROSS JOIN (SELECT unnest(range(96)) AS mtu) AS u WHERE d.date <> DATE '2024-01-22'),
v AS (SELECT 'missing' AS kind, * FROM (SELECT * FROM e EXCEPT SELECT * FROM g) UNION ALL SELECT 'extra', * FROM (SELECT * FROM g EXCEPT SELECT * FROM e))
SELECT series, model, kind, CAST(date AS VARCHAR) AS date, count(*) AS n FROM v GROUP BY 1, 2, 3, 4""")
def grid_integrity(spark, sf_dir):
    """Slots that a model of a series misses or has too many, a skipped day aside."""
    found = violations(spark, sf_dir, naive_panel(spark, sf_dir).where("y_pred is not null"), ("series",))
    return found.groupBy("series", "model", "kind", F.to_date("ts").cast("string").alias("date")).agg(F.count("*").alias("n"))


also("by_series", "gw_matrix", "gw_per_slot", "grid_integrity")


def violations(spark, sf_dir, rows, by=()):
    at = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("mtu") * 15)
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct().withColumn("mtu", F.explode(F.sequence(F.lit(0), F.lit(95))))
    skip = spark.createDataFrame([("2024-01-22",)], "d string").select(F.col("d").cast("date").alias("date"))
    return validate.grid_violations(rows.select(*by, "model", at.alias("ts")), days.select(at.alias("ts")), skip, by)


@query(f"""WITH {PANEL}, c AS (SELECT count(*) - count(y_pred) AS y_pred, count(*) - count(y_true) AS y_true, 0 AS model FROM panel)
SELECT 'y_pred' AS column_name, y_pred AS n_missing FROM c WHERE y_pred > 0 UNION ALL SELECT 'y_true', y_true FROM c WHERE y_true > 0""")
def missing_values(spark, sf_dir):
    """Columns with missing values."""
    return validate.missing_values(naive_panel(spark, sf_dir), ["y_pred", "y_true", "model"])


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, round(CAST(min({c}) AS DOUBLE), 6) AS low, round(CAST(max({c}) AS DOUBLE), 6) AS high, count(DISTINCT {c}) AS n_distinct FROM events" for c in ("event_id", "user_id", "value")))
def null_report(spark, sf_dir):
    """NULLs, range and number of distinct values of each column."""
    out = metrics.column_report(table(spark, sf_dir, "events"), ["event_id", "user_id", "value"])
    return out.select("column_name", "n_null", r6("low"), r6("high"), "n_distinct")


@query("""SELECT o_orderpriority AS model, round(avg(o_totalprice / 60), 4) AS mean_min, round(min(o_totalprice / 60), 4) AS min_min, round(max(o_totalprice / 60), 4) AS max_min FROM orders GROUP BY 1""")
def runtime_summary(spark, sf_dir):
    """Mean, shortest and longest by configuration, in minutes."""
    out = metrics.runtime_summary(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "model"), ["model"], "o_totalprice")
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("mean_min", "min_min", "max_min")])


@query(f"""WITH {PANEL} SELECT CAST(date AS VARCHAR) AS date, series, mtu, round(max(y_pred) FILTER (WHERE model = 'naive_d1'), 6) AS naive_d1, round(max(y_pred) FILTER (WHERE model = 'naive_d7'), 6) AS naive_d7,
  round(max(y_pred) FILTER (WHERE model = 'slot_mean') + 1e-9, 6) + 0.0 AS slot_mean, round(max(y_true), 6) AS y_true FROM panel GROUP BY 1, 2, 3""")
def model_panel(spark, sf_dir):
    """All models side by side with the truth."""
    return panel.pivot_models(naive_panel(spark, sf_dir), MODELS, ["date", "series", "mtu"]).select(day(), "series", "mtu", r6("naive_d1"), r6("naive_d7"), steady(F.col("slot_mean"), "slot_mean", 6), r6("y_true"))


@query(f"""WITH {PANEL}, s AS (SELECT CAST(date AS VARCHAR) AS date, series, model, avg(abs(y_pred - y_true)) AS e, {METRICS.replace(', 6)', ' + 1e-7, 4)')} FROM panel GROUP BY 1, 2, 3),
a AS (SELECT date, series, mtu, count(DISTINCT model) FILTER (WHERE y_pred IS NOT NULL) AS n FROM panel GROUP BY 1, 2, 3), c AS (SELECT CAST(date AS VARCHAR) AS date, series, count(*) FILTER (WHERE n = 3) AS n_common FROM a GROUP BY 1, 2)
SELECT date, series, model, mae, rmse, bias, n_obs, n_inf_nan, n_common, round(e / nullif(max(e) FILTER (WHERE model = 'naive_d7') OVER (PARTITION BY date, series), 0) + 1e-7, 4) AS relative_mae FROM s JOIN c USING (date, series)""")
def daily_skill(spark, sf_dir):
    """Every model's day against the weekly naive forecast, from a panel that is kept in buckets."""
    kept = stored_by(naive_panel(spark, sf_dir), "panel", ["date", "series"])
    out = metrics.daily_skill(kept, MODELS, "naive_d7", ["series"])
    return out.select(day(), "series", "model", *[steady(F.col(c), c) for c in (*ROUNDED, "relative_mae")], "n_obs", "n_inf_nan", "n_common")


@query(f"""WITH {QUANTILES} SELECT id, round(q[1], 4) AS q01, round(q[3], 4) AS q05, CASE model WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE model END AS label FROM j""")
def model_view(spark, sf_dir):
    """A wide panel's columns of one model under plain names, with labels."""
    rows = quantile_rows(spark, sf_dir)
    wide = rows.select("model", "id", F.element_at("q", 1).alias("lear_q0.100"), F.element_at("q", 3).alias("lear_q0.500"))
    view = panel.model_view(wide, "lear", [0.1, 0.5], ["model", "id"])
    return view.select("id", F.round("`q0.100`", 4).alias("q01"), F.round("`q0.500`", 4).alias("q05"), C.label_of("model", {"A": "Accepted", "R": "Returned"}).alias("label"))
