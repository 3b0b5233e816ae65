"""Regions as rings: border tracing, areas, filling, and filters by what a region holds. A ring is an array of (x = column, y = row), closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densigrid.operators.raster import PX, density, shuffled, threshold
from densigrid.operators.runs import label_runs, runs
from densigrid.operators.simple import is_simple
from densigrid.operators.tracing import trace_runs
from densigrid.sources.stage import staged

RING = "array<struct<x:int,y:int>>"


def trace(mask: DataFrame) -> DataFrame:
    """(fov, label, ring_id, hole, ring): outer and hole borders of the mask's components."""
    return trace_runs(label_runs(runs(mask.select(*PX))), "label")


def checked(rings: DataFrame) -> DataFrame:
    """Rings of three points or more, closed where they were open."""
    kept = rings.where(F.size("ring") >= 3)
    shut = F.element_at("ring", 1) == F.element_at("ring", -1)
    return kept.withColumn("ring", F.when(shut, F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1))))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring between pixel centres: a block of h x w pixels has (h - 1) * (w - 1)."""
    n = F.size(ring) - 1
    parts = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: (p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"]))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) / 2


def area_at_least(rings: DataFrame, least: float) -> DataFrame:
    return rings.where(ring_area(F.col("ring")) >= least)


def nonempty(rings: DataFrame, signal: DataFrame, *keys: str) -> DataFrame:
    """Rings, told apart by ``keys``, in which the raster ``signal`` (fov, r, c, v) sums to more than 0, outlines included."""
    kept = shuffled(fill(rings, *keys)).join(shuffled(signal.select(*PX, "v")), PX).groupBy(*keys).agg(F.sum("v").alias("_v")).where(F.col("_v") > 0).select(*keys)
    return rings.join(shuffled(kept), list(keys), "left_semi")


def region_contours(mask: DataFrame, signal: DataFrame, least: float) -> DataFrame:
    """(fov, label, ring_id, hole, ring): outer and hole borders of a mask, closed, of an area of ``least`` or more, and with some of the signal inside."""
    return nonempty(staged(area_at_least(checked(trace(mask)), least)), signal, "fov", "ring_id")  # traced once, and read twice


def contours_from_sum(signal: DataFrame, ext: DataFrame, k: int, limit: float, least: float, direction: str = "higher", shape: str = "square") -> DataFrame:
    """Contours of where the density of ``signal`` (fov, r, c, v) is above or below the limit."""
    return region_contours(threshold(density(signal, ext, k, shape), ext, limit, direction), signal, least)


def polygons(rings: DataFrame) -> DataFrame:
    """Closed rings of four points or more, the closing one counted, that enclose an area and do not cross or touch themselves."""
    kept = checked(rings.where(F.size("ring") >= 4)).where(ring_area(F.col("ring")) > 0)

    def simple(batches):
        for rows in batches:
            yield rows.assign(_simple=[is_simple([(p["x"], p["y"]) for p in ring]) for ring in rows["ring"]])

    return kept.mapInPandas(simple, T.StructType([*kept.schema.fields, T.StructField("_simple", T.BooleanType())])).where("_simple").drop("_simple")


def edges(rings: DataFrame, *keys: str) -> DataFrame:
    """One row a side of each closed ring: keys, x0, y0, x1, y1."""
    n = F.size("ring") - 1
    side = F.explode(F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))))
    return rings.select(*keys, side.alias("e")).select(*keys, "e.*")


def fill(rings: DataFrame, *keys: str) -> DataFrame:
    """(keys, r, c): pixels inside or on rings, even-odd over all rings of equal keys (so kept hole rings stay holes); outlines count.

    A row of a group collects its crossings only, one a side that meets it; pixels are made from pairs of crossings.
    """
    sides = edges(rings, *keys)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    met = sides.where(F.col("y0") != F.col("y1")).withColumn("r", F.explode(F.sequence(low, high - 1)))
    # products of two lengths are long: a side may run along a whole field
    cross = F.col("x0") + (F.col("r") - F.col("y0")).cast("long") * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    rows = met.groupBy(*keys, "r").agg(F.sort_array(F.collect_list(cross.cast("double"))).alias("at"))
    spans = rows.select(*keys, "r", "at", F.explode(F.sequence(F.lit(1), (F.size("at") / 2).cast("int"))).alias("k"))
    a, b = F.ceil(F.element_at("at", 2 * F.col("k") - 1)).cast("int"), F.floor(F.element_at("at", 2 * F.col("k"))).cast("int")
    inner = spans.select(*keys, "r", a.alias("a"), b.alias("b")).where(F.col("a") <= F.col("b")).select(*keys, "r", F.explode(F.sequence("a", "b")).alias("c"))
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1))
    steps = sides.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    on = lambda p, q: F.rint(F.col(p) + F.col("i").cast("long") * (F.col(q) - F.col(p)) / F.col("n")).cast("int")
    outline = steps.select(*keys, on("y0", "y1").alias("r"), on("x0", "x1").alias("c"))
    return inner.union(outline).distinct()


def region_sums(regions: DataFrame, present: DataFrame, targets: list[str], name: str = "n") -> DataFrame:
    """(fov, label, n): occupied pixels of the targets within each region (fov, r, c, label); regions without any keep 0."""
    rows = regions.join(shuffled(present.where(F.col("target").isin(*targets)).select(*PX, F.lit(1).alias("_one"))), PX, "left")
    return rows.groupBy("fov", "label").agg(F.count("_one").alias(name))


def by_target_threshold(regions: DataFrame, present: DataFrame, targets: list[str], least: int) -> DataFrame:
    """(fov, label, n) of regions that hold at least so many."""
    return region_sums(regions, present, targets).where(F.col("n") >= least)


def by_target_comparison(regions: DataFrame, present: DataFrame, more: list[str], fewer: list[str]) -> DataFrame:
    """(fov, label, n_more, n_fewer) of regions with strictly more of one list than of the other. One join for both."""
    rows = regions.join(shuffled(present.where(F.col("target").isin(*more, *fewer))), PX, "left")
    each = lambda names, alias: F.count(F.when(F.col("target").isin(*names), 1)).alias(alias)
    return rows.groupBy("fov", "label").agg(each(more, "n_more"), each(fewer, "n_fewer")).where(F.col("n_more") > F.col("n_fewer"))


def seed_centroids(rings: DataFrame, *keys: str) -> DataFrame:
    """(keys, cx, cy): centroids of closed rings by the shoelace sums; rings without area are left out."""
    sides = edges(rings, *keys)
    turn = F.col("x0").cast("double") * F.col("y1") - F.col("x1").cast("double") * F.col("y0")
    sums = sides.groupBy(*keys).agg(F.sum(turn).alias("t"), F.sum((F.col("x0") + F.col("x1")) * turn).alias("sx"), F.sum((F.col("y0") + F.col("y1")) * turn).alias("sy"))
    return sums.where(F.col("t") != 0).select(*keys, (F.col("sx") / (3 * F.col("t"))).alias("cx"), (F.col("sy") / (3 * F.col("t"))).alias("cy"))


def shifted(rings: DataFrame, x: float, y: float) -> DataFrame:
    """Rings moved to the origin (x, y), coordinates rounded half to even."""
    move = lambda p: F.struct(F.rint(p["x"] - F.lit(x)).cast("int").alias("x"), F.rint(p["y"] - F.lit(y)).cast("int").alias("y"))
    return rings.withColumn("ring", F.transform("ring", move))


def _axis(name: str):
    return lambda p: p[name]


def to_origin(rings: DataFrame, *keys: str) -> DataFrame:
    """Rings moved so that the least x and the least y of all rings of equal keys are 0, coordinates rounded half to even."""
    least = rings.groupBy(*keys).agg(*(F.min(F.array_min(F.transform("ring", _axis(axis)))).alias(f"_{axis}") for axis in ("x", "y")))
    move = lambda p: F.struct(F.rint(p["x"] - F.col("_x")).cast("int").alias("x"), F.rint(p["y"] - F.col("_y")).cast("int").alias("y"))
    return rings.join(least, list(keys)).withColumn("ring", F.transform("ring", move)).drop("_x", "_y")
