"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only where that is unset, in local mode, a temporary folder is made and set; on a
    cluster a folder of one machine would be lost to the others, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="slotcast-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


_made: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; all that is in it is removed when the application ends."""
    path = f"{shared_folder(spark)}/slotcast-{spark.sparkContext.applicationId}"
    if path not in _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _made.add(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, for a table that lives as long as the application."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs only the tasks it ran, and readers
    get exact sizes.  The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` written once in buckets of ``keys`` to the shared folder, and read again.

    Sums by ``keys`` (or by these and further columns) and joins of two such tables with as
    many buckets read it in place, without a shuffle, however many queries do.  ``buckets``
    is by default the session's number of shuffle partitions.  Rows are dealt before they are
    written, so each bucket is one file.  A key that holds much of the table fills one bucket:
    take keys that are finer than it.  The table is removed when the application ends.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)
