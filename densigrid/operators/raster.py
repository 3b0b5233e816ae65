"""Sparse rasters: presence, extents, channel sums and densities, all as rows (fov, r, c, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PX = ["fov", "r", "c"]


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is dealt by key and never broadcast. Spark guesses sizes from compressed files, before rows are spread over pixels: far too small, and a
    broadcast is built in the driver."""
    return rows.hint("merge")


def presence(points: DataFrame) -> DataFrame:
    """Occupied (pixel, target) pairs; points that share one count once."""
    return points.select(*PX, "target").dropDuplicates()


def extent(points: DataFrame) -> DataFrame:
    """(fov, h, w): one row a fov, small enough to be broadcast by Spark's own size check."""
    return points.groupBy("fov").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def subset(present: DataFrame, targets: list[str]) -> DataFrame:
    """Rows of the targets asked for, with the place of each in the request; one asked for twice comes twice."""
    place = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("channel")) for i, t in enumerate(targets)))
    rows = present.where(F.col("target").isin(*targets))
    return rows.withColumn("x", F.explode(F.filter(place, lambda p: p["t"] == F.col("target")))).select(*PX, "target", F.col("x.channel").alias("channel"))


def channel_sum(present: DataFrame) -> DataFrame:
    return present.groupBy(*PX).agg(F.count(F.lit(1)).alias("v"))


def target_sum(points: DataFrame, targets: list[str]) -> DataFrame:
    """The channel sum of some targets straight from points: one shuffle, by pixel, of each pixel's set of targets."""
    met = points.where(F.col("target").isin(*targets)).groupBy(*PX)
    return met.agg(F.size(F.collect_set("target")).cast("long").alias("v"))


def reraster(points: DataFrame, targets: list[str], order: str) -> DataFrame:
    """(fov, r, c, target, channel): presence of the targets asked for, channels counted from 0 as the targets first appear by ``order``, a column of row ids.

    Targets without points have no channel; the extent is that of all points.
    """
    kept = points.where(F.col("target").isin(*targets))
    first = kept.groupBy("target").agg(F.min(order).alias("at"))  # one row a target asked for
    channel = first.select("target", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "target")) - 1).alias("channel"))
    return presence(kept).join(channel, "target").select(*PX, "target", "channel")


def _mirrors(at: Column, size: Column, k: int) -> Column:
    """The place and its reflections beyond either edge, the edge itself not repeated."""
    low = F.when((at > 0) & (at <= k), -at)
    high = F.when((at >= size - 1 - k) & (at < size - 1), 2 * (size - 1) - at)
    return F.filter(F.array(at, low, high), lambda x: x.isNotNull())


def reflected(raster: DataFrame, ext: DataFrame, k: int) -> DataFrame:
    rows = raster.join(ext, "fov").withColumn("r", F.explode(_mirrors(F.col("r"), F.col("h"), k)))
    return rows.withColumn("c", F.explode(_mirrors(F.col("c"), F.col("w"), k)))


def inside(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("r") >= 0) & (F.col("r") < F.col("h")) & (F.col("c") >= 0) & (F.col("c") < F.col("w")))


def _run_on(rows: DataFrame, at: str, size: str, back: int, ahead: int, *keep: str) -> DataFrame:
    """Whole numbers v of pixels summed over back + 1 + ahead places along one axis, by sums that run on: a pixel is two steps, whatever the width, and only sums are spread."""
    line = ["fov", "c" if at == "r" else "r"]
    steps = F.array(F.struct((F.col(at) - back).alias("at"), F.col("v").alias("d")), F.struct((F.col(at) + ahead + 1).alias("at"), (-F.col("v")).alias("d")))
    moved = rows.repartition(*line).select(*line, size, *keep, F.explode(steps).alias("s")).select(*line, size, *keep, "s.at", "s.d")
    own = Window.partitionBy(*line).orderBy("at")
    # of steps at one place the last has the whole sum, and only it is not followed at once
    sums = moved.select(*line, size, *keep, "at", F.sum("d").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead("at").over(own).alias("next"))
    low, high = F.greatest("at", F.lit(0)), F.least(F.col("next"), F.col(size)) - 1
    return sums.where((F.col("v") != 0) & (low <= high)).select(*line, *keep, F.explode(F.sequence(low, high)).alias(at), "v")


def box_sum(raster: DataFrame, ext: DataFrame, k: int) -> DataFrame:
    """Sums over k x k boxes, borders reflected, down the columns first. Whole numbers are sums that run on; other numbers, whose differences would not be exact, are spread
    over k rows, which combine before they shuffle, and k columns."""
    back, ahead = k - 1 - k // 2, k // 2
    rows = reflected(raster, ext, k)
    if isinstance(raster.schema["v"].dataType, T.IntegralType):
        return _run_on(_run_on(rows, "r", "h", back, ahead, "w"), "c", "w", back, ahead).select(*PX, "v")
    by_row = rows.withColumn("r", F.explode(F.sequence(F.col("r") - back, F.col("r") + ahead))).where((F.col("r") >= 0) & (F.col("r") < F.col("h")))
    tall = by_row.groupBy("fov", "r", "c", "w").agg(F.sum("v").alias("v"))
    wide = tall.withColumn("c", F.explode(F.sequence(F.col("c") - back, F.col("c") + ahead))).where((F.col("c") >= 0) & (F.col("c") < F.col("w")))
    return wide.groupBy(*PX).agg(F.sum("v").alias("v"))


def ellipse_offsets(k: int) -> list[tuple[int, int]]:
    """Offsets of a k x k elliptic kernel from its anchor k // 2."""
    half, out = k // 2, []
    for i in range(k):
        dy = i - half
        if abs(dy) <= half:
            dx = round(half * math.sqrt(max(0.0, 1 - dy * dy / (half * half)))) if half else 0
            out += [(dy, j - half) for j in range(max(half - dx, 0), min(half + dx + 1, k))]
    return out


def kernel_sum(raster: DataFrame, ext: DataFrame, offsets: list[tuple[int, int]], k: int) -> DataFrame:
    """Sums over any kernel, borders reflected."""
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    rows = reflected(raster, ext, k).withColumn("d", F.explode(moves))
    moved = rows.withColumn("r", F.col("r") - F.col("d.dy")).withColumn("c", F.col("c") - F.col("d.dx"))
    return inside(moved).groupBy(*PX).agg(F.sum("v").alias("v"))


def density(raster: DataFrame, ext: DataFrame, k: int, shape: str = "square") -> DataFrame:
    if shape == "square":
        return box_sum(raster, ext, k)
    if shape == "circle":
        return kernel_sum(raster, ext, ellipse_offsets(k), k)
    raise ValueError(f"unknown kernel shape {shape!r}")


def grid(ext: DataFrame) -> DataFrame:
    """Every pixel of every fov, made row by row on the executors."""
    rows = ext.select("fov", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r"))
    return rows.select("fov", "r", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("c"))


def absent(px: DataFrame, ext: DataFrame) -> DataFrame:
    """Pixels of the image that are not among ``px`` (fov, r, c): what lies between those of a row. Only ``px`` and the ends of rows are dealt, by row, and sorted there; the
    other pixels are made where they are read, by as many tasks as rows are dealt to."""
    rows = ext.select("fov", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r"))
    ends = rows.select("fov", "r", F.explode(F.array(F.lit(-1), F.col("w"))).alias("c"), F.lit(1).alias("end"))
    own = Window.partitionBy("fov", "r").orderBy("c", "end")
    met = px.where(F.col("c").isNotNull()).select(*PX, F.lit(0).alias("end")).union(ends)
    met = met.withColumns({"before": F.lag("c").over(own), "ends": F.sum("end").over(own.rowsBetween(Window.unboundedPreceding, -1))})
    # between the two ends of a row of the image
    open_ = met.where((F.col("ends") == 1) & (F.col("c") - F.col("before") > 1))
    return open_.select("fov", "r", F.explode(F.sequence(F.col("before") + 1, F.col("c") - 1)).alias("c"))


def threshold(dense: DataFrame, ext: DataFrame, limit: float, direction: str = "higher") -> DataFrame:
    """Pixels strictly above or below the limit; for the latter, pixels without a row count as 0."""
    if direction == "higher":
        return dense.where(F.col("v") > limit).select(*PX)
    if direction == "lower":
        low = F.coalesce("v", F.lit(0)) < limit
        return absent(dense.where(~low), ext) if limit > 0 else inside(dense.where(low).join(ext, "fov")).select(*PX)
    raise ValueError(f"unknown direction {direction!r}")
