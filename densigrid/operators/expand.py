"""Distance rings around masks, label propagation and class-limited growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.operators import distance
from densigrid.operators.contours import fill, seed_centroids
from densigrid.operators.masks import label
from densigrid.operators.raster import PX, grid, shuffled
from densigrid.operators.regions import class_regions, finite_regions
from densigrid.operators.runs import label_runs, pixels, runs
from densigrid.sources.stage import staged

LONG = 16  # beyond this reach distances come from the transform, also where sources of very many keys are apart
LEAST_SEEDS = 4  # with fewer seeds a fov has no class regions, and nothing limits growth


def nearest_within(sources: DataFrame, ext: DataFrame, reach: int, *keys: str) -> DataFrame:
    """(keys, fov, r, c, d2, sr, sc, label): for each pixel outside the sources and within reach, the nearest source, ties to the first in raster order.

    Exact, on squared integers, and one axis at a time: the nearest in each row first, then over rows; 4 reach rows a pixel in place of its square.
    Sources of other ``keys`` are apart.
    """
    lab = F.col("label") if "label" in sources.columns else F.lit(1)
    own = sources.select(*keys, "fov", F.col("r").alias("sr"), F.col("c").alias("sc"), lab.alias("label")).join(ext, "fov")
    flat = own.withColumn("c", F.explode(F.sequence(F.greatest(F.col("sc") - reach, F.lit(0)), F.least(F.col("sc") + reach, F.col("w") - 1))))
    dx = F.col("c") - F.col("sc")
    by_row = flat.groupBy(*keys, "fov", "sr", "c", "h").agg(F.min(F.struct((dx * dx).alias("d2"), "sc", "label")).alias("s"))
    up = F.floor(F.sqrt(reach * reach - F.col("s.d2"))).cast("int")
    tall = by_row.withColumn("r", F.explode(F.sequence(F.greatest(F.col("sr") - up, F.lit(0)), F.least(F.col("sr") + up, F.col("h") - 1))))
    dy = F.col("r") - F.col("sr")
    best = tall.groupBy(*keys, *PX).agg(F.min(F.struct((F.col("s.d2") + dy * dy).alias("d2"), "sr", F.col("s.sc").alias("sc"), F.col("s.label").alias("label"))).alias("s"))
    return best.where(F.col("s.d2") > 0).select(*keys, *PX, "s.*")


def nearest(sources: DataFrame, ext: DataFrame, reach: int, *keys: str) -> DataFrame:
    """(keys, fov, r, c, d2, sr, sc, label), as of nearest_within() and of distance.transform(), which agree: the former for a short reach around sources of many keys, the latter otherwise."""
    return (nearest_within if keys and reach <= LONG else distance.transform)(sources, ext, reach, *keys)


def expanded(mask: DataFrame, ext: DataFrame, reach: int) -> DataFrame:
    """Pixels outside the mask and no farther from it than the reach."""
    return nearest(mask.select(*PX), ext, reach).select(*PX)


def _banded(distances: list[int]):
    """The first of the distances, in their order, that d2 is within."""
    ring = F.lit(None).cast("int")
    for d in reversed(distances):
        ring = F.when(F.col("d2") <= d * d, d).otherwise(ring)
    return ring


def rings(seed: DataFrame, ext: DataFrame, distances: list[int], constraint: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """(fov, r, c, ring): ring d holds pixels farther than the distance before it and no farther than d. Repeated distances count once.

    Pixels of rings' components under ``least`` pixels are dropped and come back in no later ring.
    """
    steps = sorted(set(distances))
    out = nearest(seed, ext, steps[-1]).select(*PX, _banded(steps).alias("ring"))
    if constraint is not None:
        out = out.join(shuffled(constraint.select(*PX)), PX, "left_semi")
    if least is None:
        return out
    found = label_runs(runs(out.withColumnRenamed("ring", "value"))).where(F.col("area") >= least)  # components of equal rings, all rings at once
    return pixels(found).select(*PX, F.col("value").alias("ring"))


def constrained(seed: DataFrame | None, ext: DataFrame, constraint: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The seed with its components' labels, and the constraint, all pixels where there is none."""
    if seed is None:
        raise ValueError("growth needs a seed mask")
    return label(seed), grid(ext) if constraint is None else constraint.select(*PX)


def constraint_remaining(constraint: DataFrame, ringed: DataFrame) -> DataFrame:
    """What the rings leave of the constraint; the seed stays in it."""
    return constraint.select(*PX).join(shuffled(ringed.select(*PX)), PX, "left_anti")


def propagate(seed: DataFrame, ext: DataFrame, distances: list[int]) -> DataFrame:
    """(fov, r, c, ring, label): each ring takes the labels of its nearest pixels in the seed and all rings before it. From the third ring on, what is known is
    written first, so that no ring is worked out more than twice."""
    ringed = rings(seed, ext, distances)
    steps, known, out = sorted(set(distances)), seed.select(*PX, "label"), None
    for i, d in enumerate(steps):
        reach = d - (steps[i - 1] if i else 0) + 1
        got = nearest(known, ext, reach).join(shuffled(ringed.where(F.col("ring") == d)), PX).select(*PX, "ring", "label")
        got = staged(got) if len(steps) > 2 else got
        known = known.union(got.select(*PX, "label"))
        out = got if out is None else out.union(got)
    return out


def seeds_of(rings_: DataFrame, order: list[str]) -> DataFrame:
    """(fov, idx, class, cx, cy): a seed at the centroid of each contour (fov, class, contour, ring) of an area, counted in the order of classes and contours."""
    if rings_.where(F.size("ring") >= 4).isEmpty():
        raise ValueError("no contours to take seeds from")
    place = F.array_position(F.array(*(F.lit(c) for c in order)), F.col("class"))
    idx = F.row_number().over(Window.partitionBy("fov").orderBy(place, "contour")) - 1
    return seed_centroids(rings_, "fov", "class", "contour").select("fov", idx.alias("idx"), "class", "cx", "cy")


def class_limited_rings(objects: DataFrame, ext: DataFrame, seeds: DataFrame, distances: list[int], limits: str = "nearest") -> DataFrame:
    """(fov, class, ring, r, c, label, referenced): growth of objects (fov, r, c, parent, class) within their class's region; ring 0 holds the objects themselves.

    A class's region is where one of its seeds is the nearest, or, if ``limits`` is "clamped", the finite Voronoi cells of its seeds with their corners moved into the image.

    A pixel is in the ring of the first of the distances, in the order given, that its object is within. An object may grow over another one. ``label`` is the
    largest parent of the ring and class at the pixel; ``referenced`` the largest one that grew over the pixel, of whatever class and ring, or else that of the
    objects there. Fovs with fewer than ``LEAST_SEEDS`` seeds have no limits.
    """
    own = objects.select("fov", "class", "parent", "r", "c")
    near = nearest(own.select(*own.columns), ext, max(distances), "class", "parent").select("fov", "class", "parent", "r", "c", _banded(distances).alias("ring"))
    many = seeds.groupBy("fov").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEDS).select("fov")
    used = seeds.join(many, "fov", "left_semi")
    if limits == "nearest":
        region = class_regions(near.select(*PX).distinct(), used, ext).withColumnRenamed("class", "_class")
        grown = near.join(shuffled(region), PX, "left").where(F.coalesce(F.col("_class") == F.col("class"), F.lit(True)))
    elif limits == "clamped":
        cells = staged(finite_regions(used, ext))
        held = fill(cells, "fov", "idx", "class").select("fov", "class", "r", "c").distinct().withColumn("_in", F.lit(True))
        limited = cells.select("fov").distinct().withColumn("_limited", F.lit(True))
        grown = near.join(shuffled(held), ["fov", "class", "r", "c"], "left").join(limited, "fov", "left").where(F.col("_limited").isNull() | F.col("_in").isNotNull())
    else:
        raise ValueError(f"unknown limits {limits!r}")
    grown = grown.select("fov", "class", "parent", "r", "c", "ring")
    both = grown.union(own.select("fov", "class", "parent", "r", "c", F.lit(0).alias("ring")))
    label_ = both.groupBy(*PX, "class", "ring").agg(F.max("parent").alias("label"))
    at = Window.partitionBy(*PX)
    over, under = F.max(F.when(F.col("ring") > 0, F.col("label"))).over(at), F.max("label").over(at)
    return label_.select("fov", "class", "ring", "r", "c", "label", F.coalesce(over, under).alias("referenced"))
