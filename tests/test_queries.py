"""Every registered query of the library runs; those with SQL equal it on the small tables."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from slotcast.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list:
    def say(v):
        return "" if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(say, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in SQL if QUERIES[n].__name__ == n))  # second names are the same function
def test_equals_sql(spark, sf, sql, name):
    got, want = QUERIES[name](spark, sf).toPandas(), sql.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"lasso_forecast", "quantile_forecast"}))  # those two run below
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["grid_ffill", "profile_interpolate", "gw_matrix", "nearest_centroid"])
def test_same_for_any_partitioning(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows_of(QUERIES[name](spark, sf).toPandas())
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows_of(QUERIES[name](spark, sf).toPandas()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("name", "lead"), [("rolling_window_stats_daily", 28), ("fold_scaling_daily", 56), ("anc_fold_scaling_daily", 56), ("lasso_forecast", None)])
def test_every_day_with_a_whole_window(spark, sf, sql, name, lead):
    dates = [r[0] for r in sql.sql("select distinct o_orderdate::date from orders order by 1").fetchall()]
    first = dates[7] + dt.timedelta(56) if lead is None else dates[0] + dt.timedelta(lead)  # the longest lag is seven days with orders
    got = {r["day"] for r in QUERIES[name](spark, sf).select("day").distinct().collect()}
    assert got == {str(d) for d in dates if d >= first} and len(got) > 500


def test_quantiles_of_every_day_and_slot(spark, sf, sql):
    want = {(str(r[0]), r[1], m) for r in sql.sql("select distinct ts::date, event_type from events").fetchall() for m in range(96)}
    rows = QUERIES["quantile_forecast"](spark, sf).collect()
    assert len(rows) == len(want) and {(r["day"], r["series"], r["mtu"]) for r in rows} == want


def test_p_values_of_every_series(spark, sf, sql):
    want = {r[0] for r in sql.sql("select distinct event_type from events").fetchall()}
    rows = QUERIES["gw_p_values"](spark, sf).collect()
    by = {(r["series"], r["model_a"], r["model_b"]): r["p_value"] for r in QUERIES["gw_matrix_by_series"](spark, sf).collect()}
    assert len(rows) == 3 * len(want) and {r["series"] for r in rows} == want
    assert all(r[b] == (1.0 if b == r["model_a"] else by.get((r["series"], r["model_a"], b))) for r in rows for b in ("naive_d1", "naive_d7", "slot_mean"))
