"""Exact quantiles of groups of any size, by narrowing the range of values round by round.

A round takes borders of about equal counts from a mergeable quantile summary, and counts
a group's values at and between them; only the parts that hold a wanted rank go on, each
as a range of its own.  A part of one value, or whose edge is the wanted rank, is settled by
its count; parts of few values are put in order as arrays of a bounded size.  Summaries
and counts are merged before the shuffle, so no task holds a group, and a range of n values
leaves parts of about n / 64 whatever their distribution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .spatial import coordinate_gaps, small

#: Borders of a round.
BORDERS = 63
#: Values of a range that are put in order in one task.
FEW = 4096


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in one of their group's ranges (which are disjoint), with that range as ``_i``."""
    lists = ranges.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "below", "n")).alias("_ranges"))
    own = F.get(F.filter("_ranges", lambda r: (F.col("_v") >= r["lo"]) & (F.col("_v") <= r["hi"])), F.lit(0))
    return rows.join(small(stored(lists, "ranges")), keys).select(*keys, "_v", own.alias("_i")).where("_i is not null")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], borders: int = BORDERS, few: int = FEW) -> DataFrame:
    """(keys, n, q): the quantiles of each group, linear between neighbouring values.

    NULL and NaN are skipped; a group without values is no row.  Null keys are a group.
    """
    names = keys
    keys = [f"_k{i}" for i in range(max(1, len(names)))]
    # a null key must meet itself in joins: keys are compared as structs, of which none is null
    named = [F.struct(F.col(n).alias("v")).alias(k) for n, k in zip(names, keys)] or [F.lit(0).alias(keys[0])]
    v = F.col(value).cast("double")
    rows = df.select(*named, (v + 0.0).alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "groups")
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    back = [F.col(k)["v"].alias(n) for n, k in zip(names, keys)]

    def quantiles(x) -> Column:
        between = lambda p: (F.ceil(p) - p) * x(F.floor(p)) + (p - F.floor(p)) * x(F.ceil(p))
        return F.array(*[F.when(F.floor(p) == F.ceil(p), x(F.floor(p))).otherwise(between(p)) for p in at]).alias("q")

    def in_order(some: DataFrame) -> DataFrame:
        whole = some.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_v")).alias("vs"))
        return whole.select(*back, "n", quantiles(lambda i: F.get("vs", i.cast("int"))))

    large = groups.where(F.col("n") > few)
    if large.isEmpty():
        return in_order(rows)
    # a group that few values make is put in order as it is, the others are narrowed
    done = in_order(rows.join(small(large.select(*keys)), keys, "left_anti"))
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    wanted = large.select(*keys, ranks.alias("ranks"))
    ranges = large.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    found = []
    while True:
        # settled: an edge of a range, or a range of one value; the ranks that are left decide whether a range goes on
        sure = ranges.join(wanted, keys).select(*keys, "lo", "hi", "below", "n", F.explode("ranks").alias("rank")).where("rank >= below and rank < below + n")
        known = F.when((F.col("rank") == F.col("below")) | (F.col("lo") == F.col("hi")), F.col("lo")).when(F.col("rank") == F.col("below") + F.col("n") - 1, F.col("hi"))
        sure = stored(sure.withColumn("x", known), "ranks")
        found.append(sure.where("x is not null").select(*keys, "rank", "x"))
        open_ = sure.where("x is null").select(*keys, "lo", "hi", "below", "n").distinct()
        last = open_.where(F.col("n") <= few)
        ordered = _within(rows, last, keys).groupBy(*keys, F.col("_i.lo").alias("lo"), F.col("_i.below").alias("below")).agg(F.array_sort(F.collect_list("_v")).alias("vs"))
        told = sure.where(F.col("x").isNull() & (F.col("n") <= few)).select(*keys, "lo", "below", "rank").join(ordered, [*keys, "lo", "below"])
        found.append(told.select(*keys, "rank", F.get("vs", F.col("rank") - F.col("below")).alias("x")))
        many = open_.where(F.col("n") > few)
        if many.isEmpty():
            break
        inside = _within(rows, many, keys).select(*keys, "_v", F.col("_i.lo").alias("_lo"), F.col("_i.below").alias("_below"))
        shares_of = [i / (borders + 1) for i in range(1, borders + 1)]
        cuts = inside.groupBy(*keys, "_lo").agg(F.array_distinct(F.percentile_approx("_v", shares_of, 1000)).alias("_cuts"))
        cut = inside.join(small(stored(cuts, "borders")), [*keys, "_lo"])
        # even numbers lie between borders, odd ones on a border
        part = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        counted = cut.groupBy(*keys, "_lo", "_below", part.alias("_part")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = Window.partitionBy(*keys, "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("_below") + F.coalesce(F.sum("n").over(before), F.lit(0))
        ranges = stored(counted.select(*keys, "lo", "hi", below.alias("below"), "n"), "parts")
    values = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("m"))
    return done.unionByName(large.join(values, keys).select(*back, "n", quantiles(lambda i: F.element_at("m", i.cast("long")))))


def grid_spacing(points: DataFrame, axis: str) -> DataFrame:
    """One row: the median gap of the sorted distinct coordinates."""
    return exact_quantiles(coordinate_gaps(points, axis), [], "gap", [0.5]).select(F.col("q")[0].alias("gap"))
