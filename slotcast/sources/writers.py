"""Sinks: tables, cluster files and experiment settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet, or CSV with a header."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_clusters(df: DataFrame, path: str, clusters: int, metadata: dict[str, str]) -> None:
    """Wide ``timestamp, cluster_0 ..`` CSV, left alone if it is there; metadata beside it."""
    wide = df.groupBy("ts").pivot("cluster_id", list(range(clusters))).agg(F.first("value"))
    wide = wide.withColumnsRenamed({"ts": "timestamp", **{str(i): f"cluster_{i}" for i in range(clusters)}})
    wide.write.mode("ignore").option("header", True).csv(path)
    write_config(df.sparkSession, metadata, f"{path}-metadata", "ignore")


def write_cluster_runs(df: DataFrame, root: str, clusters: int, metadata: dict[str, str]) -> None:
    """Wide ``timestamp, cluster_0 ..`` CSV of all runs in one job, one folder for each run and file.

    ``df`` is (ts, cluster_id, value, run, file), with the names of folder and file.  Files
    that are there are left alone: their keys, read from the folder names, are taken out
    first.  What is written again after a failure replaces its own folder only.  The
    metadata, with the names of run and file, are written beside.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        there = spark.read.format("binaryFile").load(root).select("run", "file").distinct()  # names only; no content is read
        df = df.join(there, ["run", "file"], "left_anti")
    wide = df.groupBy("run", "file", "ts").pivot("cluster_id", list(range(clusters))).agg(F.first("value"))
    wide = wide.withColumnsRenamed({"ts": "timestamp", **{str(i): f"cluster_{i}" for i in range(clusters)}})
    wide.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("run", "file").csv(root)
    about = df.select("run", "file").distinct().select("*", *[F.lit(v).alias(k) for k, v in metadata.items()])
    about.write.mode("append").json(f"{root}-metadata")


def experiment_name(source: str, days: int, clusters: int, variant: str) -> str:
    return f"{source}_d{days}_c{clusters}_{variant}"


def write_config(spark: SparkSession, config: dict, path: str, mode: str = "overwrite") -> None:
    """The settings of one experiment as one JSON object."""
    values = {k: v for k, v in config.items() if v is not None}
    columns = [F.array(*[F.lit(x) for x in v]).alias(k) if isinstance(v, (list, tuple)) else F.lit(v).alias(k) for k, v in values.items()]
    spark.range(1).select(*columns).coalesce(1).write.mode(mode).json(path)
