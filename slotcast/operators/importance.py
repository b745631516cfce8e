"""Contribution analysis: absolute contributions of feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature_cluster, feature_group


def group_contributions(rows: DataFrame, group: str, keys: list[str], slots: list[str]) -> DataFrame:
    """Mean over the slots of the absolute summed contribution of each group."""
    sums = rows.groupBy(*slots, *keys, group).agg(F.sum("contribution").alias("c"))
    return sums.groupBy(*keys, group).agg(F.avg(F.abs("c")).alias("anc"))


def anc_by_group(rows: DataFrame, keys: list[str], slots: list[str]) -> DataFrame:
    """By the group of the feature's name."""
    return group_contributions(rows.withColumn("feature_group", feature_group("feature")), "feature_group", keys, slots)


def anc_by_cluster(rows: DataFrame, keys: list[str], slots: list[str], mtus: tuple[int, int] | None = None) -> DataFrame:
    """By wind and solar cluster, within a window of slots."""
    if mtus:
        rows = rows.where(F.col("mtu").between(*mtus))
    return group_contributions(rows.withColumn("cluster_group", feature_cluster("feature")).where("cluster_group <> 'Other'"), "cluster_group", keys, slots)
