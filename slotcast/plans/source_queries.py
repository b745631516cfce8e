"""Queries that write given tables in the file layouts, read them back, and say what they hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timegrid, validate
from ..sources import readers, writers
from ..sources.shared import new_path
from .model_queries import points
from .registry import query, r6, steady, table

CLUSTERS = 4


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS ts, CAST(user_id % 4 AS INTEGER) AS cluster_id, avg(value) AS value FROM events GROUP BY 1, 2),
f AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS folder FROM h)
SELECT 'value' AS var, 3 AS run_hour, CAST(folder AS VARCHAR) AS folder_date, CAST(CASE WHEN folder >= DATE '2024-01-15' THEN folder + 1 ELSE folder END AS VARCHAR) AS forecast_date, cluster_id,
  count(value) AS n, round(sum(value), 6) AS total FROM f WHERE folder <> DATE '2024-01-08' GROUP BY ALL""")
def cluster_files(spark, sf_dir):
    """A week's cluster means in each run's folder, found again by name and date, one run skipped."""
    root = new_path(spark, "clusters")
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % CLUSTERS).cast("int").alias("cluster_id"))
    weeks = hours.agg(F.avg("value").alias("value")).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    stamp = F.date_format("week", "yyyyMMdd")
    names = [F.format_string("dwd_icon_daily_%s_03", stamp).alias("run"), F.format_string("value_unit_%s03_raw.csv", stamp).alias("file")]
    writers.write_cluster_runs(weeks.select("ts", "cluster_id", "value", *names), root, CLUSTERS, {"source": "events"})
    rows = readers.clustered_runs(spark, root, CLUSTERS, "2023-12-01", 3, ["2024-01-08"], "2024-01-15")
    out = rows.groupBy("var", "run_hour", F.col("folder_date").cast("string").alias("folder_date"), F.col("forecast_date").cast("string").alias("forecast_date"), "cluster_id")
    return out.agg(F.count("value").alias("n"), r6(F.sum("value"), "total"))


LAGS = [1, 7, 28]


@query(f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS y FROM orders GROUP BY 1),
l AS ({" UNION ALL ".join(f"SELECT 'orders_d{n}_c1_lag' AS model, y, lag(y, {n}) OVER (ORDER BY date) AS p FROM d" for n in LAGS)})
SELECT model, count(*) AS n_rows, count(p) AS n_pred, round(avg(abs(p - y)), 2) AS mae, round(avg(p - y), 2) + 0.0 AS bias FROM l GROUP BY 1""")
def forecast_files(spark, sf_dir):
    """Forecasts of several models written as CSV under their settings and scanned as one panel."""
    root = new_path(spark, "forecasts")
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("y_true"))
    for n in LAGS:
        rows = days.select(F.col("date").cast("timestamp_ntz").alias("timestamp"), F.lag("y_true", n).over(Window.orderBy("date")).alias("y_pred"), "y_true")  # one row for each day
        writers.write_table(rows, f"{root}/orders/d{n}/c1/lag", "csv")
    rows = readers.forecast_panel(spark, [f"{root}/*/*/*/*"], ["y_pred", "y_true"])
    error = F.col("y_pred") - F.col("y_true")
    return rows.groupBy("model").agg(F.count("*").alias("n_rows"), F.count("y_pred").alias("n_pred"), F.round(F.avg(F.abs(error)), 2).alias("mae"), (F.round(F.avg(error), 2) + 0.0).alias("bias"))


@query("""SELECT 'orders_d56_c' || count(DISTINCT o_orderpriority) || '_' || o_orderstatus AS experiment_name, 56 AS train_days, strftime(min(o_orderdate), '%Y-%m-%d') AS test_start,
  strftime(max(o_orderdate), '%Y-%m-%d') AS test_end, true AS use_vst FROM orders GROUP BY o_orderstatus""")
def experiment_settings(spark, sf_dir):
    """The settings of one experiment for each status, written as JSON and read again."""
    root = new_path(spark, "settings")
    spans = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("c"), F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    for r in spans.collect():  # one experiment for each status
        name = writers.experiment_name("orders", 56, r["c"], r["o_orderstatus"])
        writers.write_config(spark, {"experiment_name": name, "train_days": 56, "test_start": str(r["a"]), "test_end": str(r["b"]), "use_vst": True, "skip": None}, f"{root}/{name}")
    return spark.read.schema("experiment_name string, train_days int, test_start string, test_end string, use_vst boolean").json(f"{root}/*")


@query("""SELECT label AS cluster_id, 'lon' AS column_name, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 8) AS mean FROM embeddings GROUP BY 1""")
def mapped_points(spark, sf_dir):
    """A table of points and clusters written and read as Parquet; the mean of its first numeric column."""
    path = new_path(spark, "map")
    writers.write_table(points(spark, sf_dir).withColumnRenamed("label", "cluster_id"), path)
    rows = readers.cluster_map(spark, path)
    first = readers.first_numeric(rows)
    return rows.groupBy("cluster_id").agg(F.lit(first).alias("column_name"), F.count("*").alias("n"), F.round(F.avg(first), 8).alias("mean"))


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(epoch(timezone('Europe/Berlin', o_orderdate)) AS BIGINT) AS instant, count(*) AS n FROM orders GROUP BY 1, 2""")
def local_midnights(spark, sf_dir):
    """Local midnights as instants, an hour apart between summer and winter time."""
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return timegrid.localise(rows, "ts", "Europe/Berlin").groupBy("date", F.unix_seconds("ts").alias("instant")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS var, CAST(o_custkey % 3 AS INTEGER) AS cluster_id, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3),
u AS (SELECT *, 0 AS rank FROM r WHERE year(date) % 2 = 0 UNION ALL SELECT date, var, cluster_id, value / 2, 1 FROM r)
SELECT CAST(date AS VARCHAR) AS date, var, cluster_id, round(min_by(value, rank) + 1e-7, 4) AS value FROM u GROUP BY 1, 2, 3""")
def yearly_union(spark, sf_dir):
    """Two sources of the same series, the first with gaps of whole years: a value of the first where it has one."""
    by = [F.to_date("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("var"), (F.col("o_custkey") % 3).cast("int").alias("cluster_id")]
    rows = table(spark, sf_dir, "orders").groupBy(*by).agg(F.sum("o_totalprice").alias("value"))
    first = rows.where(F.year("ts") % 2 == 0).withColumn("rank", F.lit(0))
    out = readers.yearly_union(first.unionByName(rows.withColumn("value", F.col("value") / 2).withColumn("rank", F.lit(1))), "rank")
    return out.select(F.col("ts").cast("string").alias("date"), "var", "cluster_id", steady(F.col("value"), "value"))


@query("""WITH d AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders), k AS (SELECT CAST(unnest(generate_series(a + 56, b, INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT CAST(k.date AS VARCHAR) AS date, count(o_orderkey) AS n FROM k LEFT JOIN orders ON CAST(o_orderdate AS DATE) = k.date GROUP BY 1""")
def forecast_day_list(spark, sf_dir):
    """Every calendar day from the first with a whole window on, with or without orders."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    first, last = orders.agg(F.date_add(F.min("date"), 56).cast("string"), F.max("date").cast("string")).first()
    days = timegrid.day_list(spark, first, last)
    return days.join(orders.withColumn("one", F.lit(1)), "date", "left").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("one").alias("n"))


@query("""SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS date, CAST(hour(t) AS INTEGER) AS hour, count(*) AS n FROM (SELECT timezone('Europe/Berlin', timezone('UTC', o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)))) AS t FROM orders) GROUP BY 1, 2""")
def local_hours(spark, sf_dir):
    """Instants by the local clock: a day has 23 to 25 hours."""
    hour = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.expr("cast(o_orderdate as timestamp_ntz)").alias("ts"), hour.alias("h"))
    rows = timegrid.localise(rows.select((F.col("ts") + F.col("h")).alias("ts")), "ts", "UTC")
    return timegrid.wall_clock(rows).groupBy(F.to_date("ts").cast("string").alias("date"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, min(CAST({c} AS VARCHAR)) AS low FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def text_columns(spark, sf_dir):
    """The columns that are no numbers, by the schema, and what they hold."""
    orders = table(spark, sf_dir, "orders")
    names = validate.non_numeric(orders, ("o_orderdate",))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names])).alias("x")
    return orders.select(each).groupBy("x.column_name").agg(F.count("x.v").alias("n"), F.min("x.v").alias("low"))
