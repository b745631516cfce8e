"""Queries on time grids and daily profiles; each event type is a series of 15 minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, profile, timegrid
from .registry import day, query, r6, table, when

SERIES = "SELECT event_type AS series, time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2"
GRID = f"""s AS ({SERIES}), span AS (SELECT series, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM s GROUP BY series),
g AS (SELECT series, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM span),
v AS (SELECT g.series AS series, g.ts AS ts, s.value AS value FROM g LEFT JOIN s ON g.series = s.series AND g.ts = s.ts),
f AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value FROM v)"""
MTU = "CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER)"
PROFILE = f"p AS (SELECT CAST(ts AS DATE) AS date, event_type AS series, {MTU} AS mtu, avg(value) AS value FROM events GROUP BY 1, 2, 3)"


def series(spark, sf_dir):
    return timegrid.slot_means(table(spark, sf_dir, "events"), "event_type")


def slots(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "series")
    return profile.daily_profile(timegrid.with_keys(events), ["series"])


@query(f"WITH {GRID} SELECT series, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(value, 6) AS value FROM f")
def grid_ffill(spark, sf_dir):
    """Every slot with the last value of at most three slots before."""
    return timegrid.align(series(spark, sf_dir), ["series"]).select("series", when(), r6("value"))


@query(f"""WITH {GRID} SELECT series, strftime(ts, '%Y-%m-%d %H:%M') AS ts,
  CASE WHEN count(value) OVER d = count(*) OVER d THEN round(value, 6) END AS value FROM f WINDOW d AS (PARTITION BY series, CAST(ts AS DATE))""")
def incomplete_day_mask(spark, sf_dir):
    """The filled grid without the days that still have gaps."""
    grid = timegrid.align(series(spark, sf_dir), ["series"])
    return timegrid.drop_incomplete_days(grid, ["series"]).select("series", when(), r6("value"))


@query(f"WITH {PROFILE} SELECT CAST(date AS VARCHAR) AS date, series, mtu, round(value, 6) AS value FROM p")
def daily_profile(spark, sf_dir):
    """Mean by date, series and slot."""
    return slots(spark, sf_dir).select(day(), "series", "mtu", r6("value"))


@query(
    "WITH p AS (SELECT CAST(ts AS DATE) AS date, event_type AS series, hour(ts) AS h, avg(value) AS value FROM events GROUP BY 1, 2, 3) "
    "SELECT CAST(date AS VARCHAR) AS date, series, " + ", ".join(f"round(max(value) FILTER (WHERE h = {h}), 6) AS v_hour_{h:02d}" for h in range(24)) + " FROM p GROUP BY 1, 2"
)
def profile_wide(spark, sf_dir):
    """The hourly profile as an output view with one column for each hour."""
    events = timegrid.with_keys(table(spark, sf_dir, "events").withColumnRenamed("event_type", "series"))
    wide = profile.wide_profile(profile.daily_profile(events, ["series"], "hour"), ["series"], "v", 24, "hour")
    return wide.select(day(), "series", *[r6(f"v_hour_{h:02d}") for h in range(24)])


@query(f"""WITH {PROFILE}, d AS (SELECT DISTINCT date, series FROM p),
k AS (SELECT d.date AS date, d.series AS series, CAST(u.mtu AS INTEGER) AS mtu, p.value AS value
  FROM d CROSS JOIN (SELECT unnest(range(96)) AS mtu) AS u LEFT JOIN p ON p.date = d.date AND p.series = d.series AND p.mtu = u.mtu),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN mtu END IGNORE NULLS) OVER a AS ps, last_value(value IGNORE NULLS) OVER a AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN mtu END IGNORE NULLS) OVER b AS ns, first_value(value IGNORE NULLS) OVER b AS nv FROM k
  WINDOW a AS (PARTITION BY date, series ORDER BY mtu ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY date, series ORDER BY mtu ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT CAST(date AS VARCHAR) AS date, series, mtu,
  round(coalesce(value, CASE WHEN mtu - ps <= 4 AND ns IS NOT NULL THEN pv + (nv - pv) * (CAST(mtu - ps AS DOUBLE) / (ns - ps)) END), 6) AS value FROM n""")
def profile_interpolate(spark, sf_dir):
    """Gaps of a profile filled between valid slots, four at most."""
    skeleton = profile.slot_skeleton(slots(spark, sf_dir), ["series"])
    return profile.interpolate(skeleton, ["series"], 4).select(day(), "series", "mtu", r6("value"))


@query(f"""WITH {PROFILE} SELECT CAST(date AS VARCHAR) AS date, series, mtu, round(value, 6) AS value,
  round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 2) OVER w, 6) AS lag_2, round(lag(value, 7) OVER w, 6) AS lag_7
FROM p WINDOW w AS (PARTITION BY series, mtu ORDER BY date)""")
def lagged_profiles(spark, sf_dir):
    """The slot's value on the 1st, 2nd and 7th available day before."""
    return profile.day_lag(slots(spark, sf_dir), ["series"], [1, 2, 7]).select(day(), "series", "mtu", r6("value"), *[r6(f"lag_{n}") for n in (1, 2, 7)])


@query(f"""WITH {PROFILE} SELECT CAST(p.date AS VARCHAR) AS date, p.series AS series, p.mtu AS mtu, round(p.value, 6) AS value, round(a.value, 6) AS lag_1, round(b.value, 6) AS lag_7
FROM p LEFT JOIN p AS a ON a.series = p.series AND a.mtu = p.mtu AND a.date + 1 = p.date LEFT JOIN p AS b ON b.series = p.series AND b.mtu = p.mtu AND b.date + 7 = p.date""")
def calendar_lagged_profiles(spark, sf_dir):
    """As lagged_profiles by calendar days."""
    return profile.day_lag(slots(spark, sf_dir), ["series"], [1, 7], calendar=True).select(day(), "series", "mtu", r6("value"), r6("lag_1"), r6("lag_7"))


@query(f"""WITH s AS ({SERIES}) SELECT s.series AS series, strftime(s.ts, '%Y-%m-%d %H:%M') AS ts, round(s.value, 6) AS value, round(a.value, 6) AS lag_1d, round(b.value, 6) AS lag_2d, round(c.value, 6) AS lag_7d
FROM s LEFT JOIN s AS a ON a.series = s.series AND a.ts = s.ts - INTERVAL 1 DAY LEFT JOIN s AS b ON b.series = s.series AND b.ts = s.ts - INTERVAL 2 DAY
LEFT JOIN s AS c ON c.series = s.series AND c.ts = s.ts - INTERVAL 7 DAY""")
def time_lag(spark, sf_dir):
    """The value exactly 1, 2 and 7 days before."""
    return profile.time_lag(series(spark, sf_dir), ["series"], [1, 2, 7]).select("series", when(), r6("value"), *[r6(f"lag_{n}d") for n in (1, 2, 7)])


@query(f"""WITH {PROFILE} SELECT CAST(date AS VARCHAR) AS date, series, mtu, round(value - lag(value) OVER (PARTITION BY series, date ORDER BY mtu), 6) AS diff FROM p""")
def profile_changes(spark, sf_dir):
    """Differences along the day."""
    return profile.step_changes(slots(spark, sf_dir), ["series", "date"], "mtu").select(day(), "series", "mtu", r6("diff"))


@query("""WITH d AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT series, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY series)
SELECT g.series AS series, CAST(g.date AS VARCHAR) AS date, round(value, 2) AS value, coalesce(n, 0) AS n FROM g LEFT JOIN d ON d.series = g.series AND d.date = g.date""")
def complete_calendar(spark, sf_dir):
    """Daily sums of orders with the missing days put in."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"))
    sums = days.agg(F.sum("o_totalprice").alias("value"), F.count("*").alias("n"))
    return timegrid.complete_days(sums, ["series"]).select("series", day(), F.round("value", 2).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1)
SELECT CAST(d.date AS VARCHAR) AS date, round(value, 3) AS value FROM d LEFT JOIN l ON l.date = d.date""")
def align_to_days(spark, sf_dir):
    """Shipped quantity on exactly the days that have orders."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))
    return timegrid.align_days(shipped, days).select(day(), F.round("value", 3).alias("value"))


@query("""SELECT event_type AS series, CAST(hour(ts - INTERVAL 15 MINUTE) AS INTEGER) AS hour, count(*) AS n, round(avg(value), 6) AS value
FROM events WHERE CAST(ts - INTERVAL 15 MINUTE AS DATE) = DATE '2024-01-10' GROUP BY 1, 2""")
def interval_start_day(spark, sf_dir):
    """Interval ends moved to starts, then one local day by the calendar."""
    rows = timegrid.local_day(timegrid.shift(table(spark, sf_dir, "events"), -15), F.lit("2024-01-10").cast("date"))
    return rows.groupBy(F.col("event_type").alias("series"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query("""SELECT event_type AS series, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:45:00' AND CAST(ts AS DATE) NOT IN (DATE '2024-01-10', DATE '2024-01-12') GROUP BY 1""")
def time_slice(spark, sf_dir):
    """A closed time window without skipped days."""
    skip = spark.createDataFrame([("2024-01-10",), ("2024-01-12",)], "date string").select(F.col("date").cast("date").alias("date"))
    rows = timegrid.time_slice(table(spark, sf_dir, "events"), "2024-01-05 00:00:00", "2024-01-20 23:45:00", skip=skip)
    return rows.groupBy(F.col("event_type").alias("series")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH s AS ({SERIES}), g AS (SELECT series, date_diff('second', lag(ts) OVER (PARTITION BY series, CAST(ts AS DATE) ORDER BY ts), ts) AS seconds FROM s),
c AS (SELECT series, seconds, count(*) AS n FROM g WHERE seconds IS NOT NULL GROUP BY 1, 2)
SELECT series, CAST(arg_max(seconds, n * 1000000 - seconds) AS BIGINT) AS seconds FROM c GROUP BY series""")
def inferred_step(spark, sf_dir):
    """The most frequent step of each series within its days."""
    return timegrid.inferred_step(series(spark, sf_dir), ["series"]).select("series", F.col("seconds").cast("long").alias("seconds"))


@query("""WITH k AS (SELECT *, CAST(ts AS DATE) AS date FROM events)
SELECT user_id, CAST(date AS VARCHAR) AS date, event_type, round(arg_max(value, event_id), 6) AS value FROM k GROUP BY 1, 2, 3""")
def dedupe_keep_last(spark, sf_dir):
    """The last event by key."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "event_type", "event_id", "value")
    return panel.keep_last(rows, ["user_id", "date", "event_type"], "event_id").select("user_id", day(), "event_type", r6("value"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT o_custkey, min(o_orderkey) AS o_orderkey, round(arg_min(o_totalprice, o_orderkey), 2) AS o_totalprice FROM k GROUP BY 1""")
def dedupe_keep_first(spark, sf_dir):
    """The first order of each customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rank", F.col("o_orderkey"))
    return panel.keep_first(rows, ["o_custkey"], "rank").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT event_type FROM c ORDER BY n DESC, event_type LIMIT 1)
SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM t) GROUP BY 1, 2""")
def longest_series(spark, sf_dir):
    """The rows of the longest series, counted by user."""
    return panel.longest_series(table(spark, sf_dir, "events"), "event_type").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
