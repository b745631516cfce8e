"""Scans: clustered weather files, forecast panels, raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import null_if_nan
from ..operators.panel import keep_first


def clustered_csv(
    spark: SparkSession, paths: str | list[str], clusters: int, start: str = "0001-01-01", run_hour: int | None = None, skip: list[str] | None = None
) -> DataFrame:
    """(ts, cluster_id, value, file_name, file_path) of clustered weather files (O1).

    Lines that start with ``#`` are comments.  A file without ``timestamp`` is an error.
    With ``run_hour`` only the files that :func:`select_runs` would keep are read (O3).
    """
    names = [f"cluster_{i}" for i in range(clusters)]
    schema = T.StructType([T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(n, T.DoubleType()) for n in names])
    reader = spark.read.option("comment", "#").option("header", True).option("recursiveFileLookup", True)
    if "timestamp" not in reader.csv(paths).columns:
        raise ValueError("a clustered file needs a column timestamp")
    wide = reader.schema(schema).option("enforceSchema", False).csv(paths)
    if run_hour is not None:  # a condition on the path alone, which the scan knows before it opens a file
        found = _attributes(F.col("_metadata.file_name"), F.col("_metadata.file_path"))
        wide = wide.where(_wanted(found["folder_date"], found["run_hour"], start, run_hour, skip))
    wide = wide.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"))
    rows = wide.unpivot(["timestamp", "file_name", "file_path"], names, "cluster", "value")
    return rows.select(F.col("timestamp").alias("ts"), F.regexp_extract("cluster", r"(\d+)", 1).cast("int").alias("cluster_id"), null_if_nan("value").alias("value"), "file_name", "file_path")


def _attributes(name: Column, path: Column) -> dict[str, Column]:
    """var, run_hour and folder_date as a file's name and path say; NULL where they do not parse (O2)."""
    run = F.regexp_extract(name, r"(?:^|_)(\d{10})(?:_|\.)", 1)
    folder = F.regexp_extract(path, r"/[^/_]+_[^/_]+_[^/_]+_(\d{8})_\d{2}/", 1)
    return {
        "var": F.regexp_extract(name, r"^([^_]+)_", 1), "run_hour": F.when(run != "", F.substring(run, 9, 2).cast("int")),
        "folder_date": F.when(folder != "", F.to_date(folder, "yyyyMMdd")),
    }


def with_file_attributes(rows: DataFrame) -> DataFrame:
    """Adds var, run_hour and folder_date from the file's name and folder (O2)."""
    return rows.withColumns(_attributes(F.col("file_name"), F.col("file_path")))


def _wanted(day: Column, hour: Column, start: str, run_hour: int, skip: list[str] | None) -> Column:
    kept = day.isNotNull() & (hour == run_hour) & (day >= F.lit(start).cast("date"))
    return kept & ~day.isin([F.lit(s).cast("date") for s in skip]) if skip else kept


def _forecast_date(day: Column, shifted_since: str | None) -> Column:
    return F.when(day >= F.lit(shifted_since).cast("date"), F.date_add(day, 1)).otherwise(day) if shifted_since else day


def select_runs(rows: DataFrame, start: str, run_hour: int, skip: list[str] | None = None, shifted_since: str | None = None) -> DataFrame:
    """Files of one run hour from ``start`` on, without skipped folders (O3).

    Names that do not parse are left out.  ``forecast_date`` is the folder's date, or
    the day after from ``shifted_since`` on.
    """
    day = F.col("folder_date")
    return rows.where(_wanted(day, F.col("run_hour"), start, run_hour, skip)).withColumn("forecast_date", _forecast_date(day, shifted_since))


def clustered_runs(
    spark: SparkSession, root: str, clusters: int, start: str, run_hour: int, skip: list[str] | None = None, shifted_since: str | None = None
) -> DataFrame:
    """The cells of :func:`select_runs` from a folder that ``write_cluster_runs`` filled (O1-O3).

    Folder and file name are partition columns there, so what is not wanted is ruled out
    when the scan is planned: its files are neither opened nor listed as tasks.
    """
    names = [f"cluster_{i}" for i in range(clusters)]
    fields = [T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(n, T.DoubleType()) for n in names]
    parts = [T.StructField("run", T.StringType()), T.StructField("file", T.StringType())]
    wide = spark.read.schema(T.StructType(fields + parts)).option("comment", "#").option("header", True).option("enforceSchema", False).csv(root)
    found = _attributes(F.col("file"), F.concat(F.lit("/"), "run", F.lit("/")))
    wide = wide.where(_wanted(found["folder_date"], found["run_hour"], start, run_hour, skip))
    rows = wide.unpivot(["timestamp", "run", "file"], names, "cluster", "value").withColumns(found)
    cluster = F.regexp_extract("cluster", r"(\d+)", 1).cast("int").alias("cluster_id")
    return rows.select(
        F.col("timestamp").alias("ts"), cluster, null_if_nan("value").alias("value"), *found, _forecast_date(F.col("folder_date"), shifted_since).alias("forecast_date")
    )


def yearly_union(rows: DataFrame, rank: str) -> DataFrame:
    """One value for each (ts, var, cluster_id): the one of the first source."""
    return keep_first(rows.select("ts", "var", "cluster_id", "value", rank), ["ts", "var", "cluster_id"], rank)


def first_numeric(df: DataFrame) -> str:
    """Name of the first numeric column."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            return f.name
    raise ValueError("no numeric column")


PATH_PARTS = r"/([^/]+)/d(\d+)/c(\d+)/([^/]+)/[^/]*$"


def forecast_panel(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """One scan of all models' forecast files; ``model`` comes from the path.

    ``.../{source}/d{days}/c{clusters}/{variant}/forecast.csv`` is the model
    ``{source}_d{days}_c{clusters}_{variant}``.  Missing columns are an error.
    """
    wide = spark.read.option("header", True).csv(paths)
    missing = [c for c in ["timestamp", *required] if c not in wide.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, PATH_PARTS, i)
    model = F.concat(part(1), F.lit("_d"), part(2), F.lit("_c"), part(3), F.lit("_"), part(4))
    return wide.select(model.alias("model"), F.to_timestamp("timestamp").alias("ts"), *[null_if_nan(F.col(f"`{c}`").cast("double")).alias(c) for c in required])


def quantiles_long(panel: DataFrame, taus: list[float], keys: list[str]) -> DataFrame:
    """Quantile columns ``q%.3f`` as rows (keys, tau, q)."""
    names = [f"q{t:.3f}" for t in taus]
    pairs = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"`{n}`").alias("q")) for t, n in zip(taus, names)])
    return panel.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.tau", "p.q")


def cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, cluster_id from Parquet."""
    return spark.read.parquet(path).select("lon", "lat", "cluster_id")
