"""Grid points, regions, clusters and cluster means."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: A side of at most this many rows is sent to all tasks; a longer one is shuffled.
SMALL_ROWS = 50_000
EARTH_KM = 6371.0088
#: A cell as wide as the buffer is split in sixteen at most so many times.
LEVELS = 3


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint, given only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _edge_kilometres(lon: Column, lat: Column) -> Column:
    """Distance of (lon, lat) to the edge (lon1, lat1)-(lon2, lat2) on the local plane."""
    east, north = F.radians(F.lit(1.0)) * EARTH_KM * F.cos(F.radians(lat)), F.radians(F.lit(1.0)) * EARTH_KM
    ax, ay = (F.col("lon1") - lon) * east, (F.col("lat1") - lat) * north
    bx, by = (F.col("lon2") - lon) * east, (F.col("lat2") - lat) * north
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def _slabs(places: DataFrame, edges: DataFrame, height: float) -> DataFrame:
    """(lon, lat) of the places inside: points meet the edges of their latitude band only."""
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    dealt = edges.where(low < high).withColumn("_band", F.explode(F.sequence(F.floor(low / height), F.floor(high / height))))
    met = places.withColumn("_band", F.floor(F.col("lat") / height)).join(dealt, "_band")
    spans = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * F.try_divide(F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1"))
    crosses = F.coalesce(spans & (F.col("lon") < at), F.lit(False))
    return met.groupBy("lon", "lat").agg((F.count_if(crosses) % 2 == 1).alias("_in")).where("_in").select("lon", "lat")


def _pieces(edges: DataFrame, size: float) -> DataFrame:
    """``edges`` cut into pieces no longer than ``size`` along an axis, each with the box it fills; ``_lon_0`` and ``_lat_0`` are its first end."""
    long = F.greatest(F.abs(F.col("lon2") - F.col("lon1")), F.abs(F.col("lat2") - F.col("lat1")))
    pieces = F.greatest(F.ceil(long / size), F.lit(1))
    cut = edges.withColumn("_k", pieces).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    on = lambda c, i: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (F.col("_i") - i) / F.col("_k")
    ends = {f"_{c}_{name}": f(on(c, 1), on(c, 0)) for c in ("lon", "lat") for name, f in (("lo", F.least), ("hi", F.greatest))}
    return cut.withColumns(ends | {"_lon_0": on("lon", 1), "_lat_0": on("lat", 1)})


def _cells_near(boxes: DataFrame, buffer_km: float, size: float) -> DataFrame:
    """``boxes`` dealt to the cells ``_x``, ``_y`` that hold a place within the buffer of them."""
    reach = buffer_km / (math.radians(1.0) * EARTH_KM)
    slack = size * 1e-6
    widest = F.cos(F.radians(F.least(F.greatest(F.abs("_lat_lo"), F.abs("_lat_hi")) + reach + slack, F.lit(90.0))))
    east = F.least(reach / F.greatest(widest, F.lit(1e-9)), F.lit(360.0)) + slack
    cells = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    boxed = boxes.withColumn("_x", F.explode(cells(F.col("_lon_lo") - east, F.col("_lon_hi") + east)))
    return boxed.withColumn("_y", F.explode(cells(F.col("_lat_lo") - reach - slack, F.col("_lat_hi") + reach + slack)))


def _reached(places: DataFrame, edges: DataFrame, buffer_km: float, size: float) -> DataFrame:
    """(lon, lat) of the places within the buffer: points meet the edges that reach their grid cell only.

    Edges are cut into pieces no longer than a cell, so a long one reaches the cells along it and not all of its box.
    """
    dealt = _cells_near(_pieces(edges, size), buffer_km, size).select("_x", "_y", "lon1", "lat1", "lon2", "lat2").distinct()
    here = places.withColumn("_x", F.floor(F.col("lon") / size)).withColumn("_y", F.floor(F.col("lat") / size))
    near = here.join(dealt, ["_x", "_y"]).where(_edge_kilometres(F.col("lon"), F.col("lat")) <= buffer_km)
    return near.select("lon", "lat").distinct()


def _reached_by_cells(places: DataFrame, edges: DataFrame, buffer_km: float, size: float, levels: int) -> DataFrame:
    """The same where a buffer holds many edges: whole cells are inside or outside, and only points between meet edges.

    Pairs of a cell and a cell where edges begin have a least and a largest distance.  A
    cell that is within the buffer of another as a whole is inside; pairs beyond the buffer, or
    farther than another pair reaches at most, are dropped.  The cells that are left are
    split in sixteen, ``levels`` times, down to ``size``, so the work on cells goes with the
    outline's length, whatever the points.
    """
    north, slack, wide = math.radians(1.0) * EARTH_KM, size * 1e-6, size / 4
    ends = _pieces(edges, wide).withColumn("_ex", F.floor(F.col("_lon_0") / size)).withColumn("_ey", F.floor(F.col("_lat_0") / size))
    ends = stored(ends.select("_ex", "_ey", "lon1", "lat1", "lon2", "lat2"), "edge-cells")
    held = stored(ends.select("_ex", "_ey").distinct(), "held-cells")
    up = lambda c, k: F.shiftright(F.col(c), 2 * k)
    pairs, leaves = None, []
    for k in range(levels, -1, -1):
        own = size * 4**k
        there = held.select(up("_ex", k).alias("_ex"), up("_ey", k).alias("_ey")).distinct()
        if pairs is None:
            box = {"_lon_lo": F.col("_ex") * own - wide, "_lon_hi": (F.col("_ex") + 1) * own + wide, "_lat_lo": F.col("_ey") * own - wide, "_lat_hi": (F.col("_ey") + 1) * own + wide}
            pairs = _cells_near(there.withColumns(box), buffer_km, own)
        else:
            inner = there.withColumn("_px", up("_ex", 1)).withColumn("_py", up("_ey", 1))
            split = pairs.withColumnsRenamed({"_ex": "_px", "_ey": "_py"}).join(inner, ["_px", "_py"])
            steps = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
            split = split.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
            pairs = split.withColumn("_x", F.col("_x") * 4 + F.col("_i")).withColumn("_y", F.col("_y") * 4 + F.col("_j"))
        low_lat, high_lat = F.col("_y") * own - slack, (F.col("_y") + 1) * own + slack
        far, close = F.greatest(F.abs(low_lat), F.abs(high_lat)), F.when(low_lat * high_lat <= 0, 0.0).otherwise(F.least(F.abs(low_lat), F.abs(high_lat)))
        least_east = F.when(far >= 90, 0.0).otherwise(F.cos(F.radians(far))) * north
        most_east = F.when(far >= 90, 1.0).otherwise(F.cos(F.radians(close))) * north
        dx, dy = F.abs(F.col("_x") - F.col("_ex")) * own, F.abs(F.col("_y") - F.col("_ey")) * own
        gap = lambda d: F.greatest(d - own - wide - slack, F.lit(0.0))
        low, high = F.hypot(gap(dx) * least_east, gap(dy) * north), F.hypot((dx + own + slack) * most_east, (dy + own + slack) * north)
        # in a hair's breadth of the buffer a pair stays
        bounded = pairs.select("_x", "_y", "_ex", "_ey", low.alias("_low"), high.alias("_high")).where(F.col("_low") <= buffer_km * (1 + 1e-9))
        bounded = stored(bounded, "cell-pairs")
        cells = bounded.groupBy("_x", "_y").agg(F.min("_high").alias("_least"))
        cells = stored(cells.withColumn("_sure", F.col("_least") <= buffer_km * (1 - 1e-9)), "cells")
        leaves.append(cells.where("_sure" if k else "true").select(F.lit(k).alias("_level"), "_x", "_y", "_sure"))
        pairs = bounded.join(cells.where("not _sure"), ["_x", "_y"]).where(F.col("_low") <= F.col("_least") * (1 + 1e-9)).select("_x", "_y", "_ex", "_ey")
    fine = places.withColumn("_fx", F.floor(F.col("lon") / size)).withColumn("_fy", F.floor(F.col("lat") / size))
    fine = fine.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    fine = fine.withColumns({f"_{c}": F.expr(f"shiftright(_f{c}, 2 * _level)") for c in "xy"})
    met = stored(fine.join(small(stored(reduce(DataFrame.unionByName, leaves), "leaves")), ["_level", "_x", "_y"]).select("lon", "lat", "_x", "_y", "_sure"), "met")
    between = met.where("not _sure").join(pairs, ["_x", "_y"]).join(ends, ["_ex", "_ey"])
    near = between.where(_edge_kilometres(F.col("lon"), F.col("lat")) <= buffer_km).select("lon", "lat").distinct()
    return met.where("_sure").select("lon", "lat").unionByName(near)


def region_mask(points: DataFrame, edges: DataFrame, buffer_km: float = 0.0) -> DataFrame:
    """``points`` (lon, lat) with ``inside``: in the polygon or within the buffer.

    ``edges`` (lon1, lat1, lon2, lat2) of all rings is the outline of a region, of any
    size.  A ray to the east crosses the outline an odd number of times from inside: points
    and edges are joined by latitude band.  For the buffer they are joined by grid cell.
    Bands and cells are as high as the mean edge, and cells at least as the buffer.  Where
    the buffer is many edges wide, cells are settled as a whole first.
    Points without a coordinate are outside.
    """
    edges = edges.select("lon1", "lat1", "lon2", "lat2").dropna()
    mean_lat, mean_lon = edges.agg(F.avg(F.abs(F.col("lat2") - F.col("lat1"))), F.avg(F.abs(F.col("lon2") - F.col("lon1")))).first()
    places = points.select("lon", "lat").distinct().dropna()
    if mean_lat is None:
        return points.withColumn("inside", F.lit(False))
    inside = _slabs(places, edges, max(mean_lat, 1e-9))
    edge = max(mean_lat, mean_lon, 1e-9)
    size = max(edge, 1.01 * buffer_km / (math.radians(1.0) * EARTH_KM))
    levels = min(LEVELS, int(math.log(size / edge, 4)))
    near = _reached_by_cells(places, edges, buffer_km, size / 4**levels, levels) if levels else _reached(places, edges, buffer_km, size)
    marked = inside.unionByName(near).distinct().withColumn("inside", F.lit(True))
    return points.join(marked, ["lon", "lat"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def kmeans(points: DataFrame, k: int, columns: list[str], seed: int = 42) -> DataFrame:
    """``points`` with ``cluster_raw``, a k-means label over the columns."""
    rows = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster_raw").fit(rows)
    return model.transform(rows).drop("_x")


def renumber_north_to_south(points: DataFrame, raw: str = "cluster_raw", lat: str = "lat") -> DataFrame:
    """``cluster_id`` from 0 by falling mean latitude of the raw cluster.

    Only the table of centroids, one row for each cluster, is sorted.
    """
    order = Window.orderBy(F.desc("_lat"), raw)
    ids = points.groupBy(raw).agg(F.avg(lat).alias("_lat")).select(raw, (F.row_number().over(order) - 1).alias("cluster_id"))
    return points.join(ids, raw)


def nearest_cluster(points: DataFrame, mapped: DataFrame, id_col: str, cell: float = 0.25) -> DataFrame:
    """(id, cluster_id, dist2): the cluster of the nearest mapped point in degrees.

    ``mapped`` has lon, lat and cluster_id; ties go to the smaller id.  Both sides are
    binned to cells of ``cell`` degrees and joined with their neighbour cells.  A hit
    no farther than one cell is final; the other points search rings of twice the
    width, so every round is an equi-join and the rest shrinks.
    """
    box = mapped.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if box[0] is None:
        return points.select(F.col(id_col), F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("double").alias("dist2")).limit(0)
    own = points.select(id_col, "lon", "lat")
    edge = own.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    width = max([box[1] - box[0], box[3] - box[2], *(abs(a - b) for a in edge if a is not None for b in box)], default=0.0) + cell
    done, rest, size = None, own, cell
    steps = F.sequence(F.lit(-1), F.lit(1))
    while True:
        there = mapped.select(F.col("lon").alias("_x"), F.col("lat").alias("_y"), "cluster_id", F.floor(F.col("lon") / size).alias("_i"), F.floor(F.col("lat") / size).alias("_j"))
        here = rest.withColumn("_i", F.floor(F.col("lon") / size)).withColumn("_j", F.floor(F.col("lat") / size))
        here = here.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
        here = here.withColumn("_i", F.col("_i") + F.col("_a")).withColumn("_j", F.col("_j") + F.col("_b"))
        d2 = F.pow(F.col("lon") - F.col("_x"), 2) + F.pow(F.col("lat") - F.col("_y"), 2)
        best = here.join(there, ["_i", "_j"]).groupBy(id_col).agg(F.min(F.struct(d2.alias("d"), "cluster_id")).alias("_m"))
        found = best.select(id_col, F.col("_m.cluster_id").alias("cluster_id"), F.col("_m.d").alias("dist2"))
        if size >= width:
            return found if done is None else done.unionByName(found)
        final = found.where(F.col("dist2") <= size * size)
        done = final if done is None else done.unionByName(final)
        rest = rest.join(final.select(id_col), id_col, "left_anti")
        size *= 8


def cluster_means(field: DataFrame, mapping: DataFrame, on: list[str], by: list[str], value: str = "value") -> DataFrame:
    """(by, cluster_id, value): mean over the points of a cluster, NaN skipped.

    A cluster of the map without values has NULL for every time.
    """
    mapped = mapping.select(*on, "cluster_id")
    means = field.join(small(mapped), on).groupBy(*by, "cluster_id").agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))
    ids = mapping.select("cluster_id").distinct()
    empty = ids.join(means.select("cluster_id").distinct(), "cluster_id", "left_anti")
    if empty.isEmpty():
        return means
    times = field.select(*by).distinct()
    gaps = times.join(small(empty), how="cross").withColumn(value, F.lit(None).cast("double"))
    return means.unionByName(gaps.select(means.columns))


def coordinate_gaps(points: DataFrame, axis: str) -> DataFrame:
    """(gap) between neighbours of the sorted distinct coordinates.

    Coordinates are dealt to partitions by range; the first of each is compared with the
    last of the partition before, so none sees all.
    """
    values = points.where(F.col(axis).isNotNull()).select(F.col(axis).alias("v")).distinct()
    dealt = stored(values.repartitionByRange("v").withColumn("_part", F.spark_partition_id()), "coordinates")
    own = dealt.withColumn("_before", F.lag("v").over(Window.partitionBy("_part").orderBy("v")))
    ends = dealt.groupBy("_part").agg(F.max("v").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("_part", "hi"))).alias("e"))  # a row for each partition
    border = ends.select(F.posexplode("e").alias("i", "x"), "e").where("i > 0").select(F.col("x._part").alias("_part"), F.get("e", F.col("i") - 1)["hi"].alias("_border"))
    joined = own.join(F.broadcast(border), "_part", "left")
    return joined.select((F.col("v") - F.coalesce("_before", "_border")).alias("gap")).where("gap is not null")


def cell_boxes(points: DataFrame, lon_gap: float, lat_gap: float) -> DataFrame:
    """Adds the four sides of each point's cell."""
    return points.withColumns({
        "lon_min": F.col("lon") - lon_gap / 2, "lon_max": F.col("lon") + lon_gap / 2,
        "lat_min": F.col("lat") - lat_gap / 2, "lat_max": F.col("lat") + lat_gap / 2,
    })


def flatten_steps(df: DataFrame, start: str, end: str, shift_hours: int = 1, per_second: float = 3600.0) -> DataFrame:
    """One time axis from run time and step, energy to power, NULL and NaN to 0.

    The label is ``valid_time`` (else ``time``) moved back to the interval's start.
    """
    ts = F.coalesce("valid_time", "time") - F.make_dt_interval(F.lit(0), F.lit(shift_hours))
    value = F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0)) / per_second
    return df.withColumn("ts", ts).withColumn("value", value).where(F.col("ts").between(F.lit(start), F.lit(end)))


def mean_to_flux(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", step_type: str | None = None) -> DataFrame:
    """De-accumulates a running mean since the start of a run.

    Flux is the change of mean times elapsed seconds over the change of time, at least
    0; NULL in the first row and where time stands still.  Runs of one row, and step
    types other than averages or sums, stay as they are.
    """
    run = Window.partitionBy(*keys).orderBy(ts)
    whole = Window.partitionBy(*keys)
    second = F.timestamp_diff("MICROSECOND", F.min(ts).over(whole), F.col(ts)) / 1e6
    rows = df.withColumn("_t", second).withColumn("_e", F.col(value) * F.col("_t")).withColumn("_n", F.count(F.lit(1)).over(whole))
    dt = F.col("_t") - F.lag("_t").over(run)
    de = F.col("_e") - F.lag("_e").over(run)
    flux = F.when(dt.isNotNull() & (dt != 0) & de.isNotNull(), F.greatest(F.lit(0.0), de / dt))
    applies = F.col("_n") >= 2
    if step_type:
        applies = applies & F.lower(step_type).rlike("avg|acc|mean")
    return rows.withColumn(value, F.when(applies, flux).otherwise(F.col(value))).drop("_t", "_e", "_n")


def attach(clusters: DataFrame, scores: DataFrame, train_days: int, cluster: str = "cluster_id") -> DataFrame:
    """``clusters`` with the scores of one training length; raises on gaps."""
    own = scores.where(F.col("train_days") == train_days).drop("train_days")
    if own.isEmpty():
        known = [r[0] for r in scores.select("train_days").distinct().orderBy("train_days").limit(50).collect()]
        raise ValueError(f"no scores for {train_days} training days; there are {known}")
    missing = [r[0] for r in clusters.join(own, cluster, "left_anti").select(cluster).distinct().orderBy(cluster).limit(50).collect()]
    if missing:
        raise ValueError(f"clusters without score: {missing}")
    return clusters.join(own, cluster)
