"""Regions of seeds: the nearest seed of every pixel by an index of grid cells, and finite Voronoi cells cut to the image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.operators.contours import RING, fill
from densigrid.operators.groups import by_group
from densigrid.operators.raster import PX, shuffled
from densigrid.operators.triangulation import finite_cells

CELLS = (16384, 4096, 1024, 256, 64, 16)  # sides of the index's cells, each a quarter of the one before


def candidates(seeds: DataFrame, ext: DataFrame) -> DataFrame:
    """(fov, ty, tx, idx, class, cx, cy): for every tile of the least cells' side, the seeds (fov, idx, class, cx, cy) that may be nearest to one of its pixels.

    From the largest cells down, a cell takes over its parent's seeds but for those that are farther from all of it than another one is from any of it. So a cell keeps the
    seeds around it, not those of its field, and every level is one shuffle by cell. Distances are of doubles: a seed is only left out where that is sure.
    """
    now = seeds.join(ext, "fov").withColumns({"ty": F.lit(0), "tx": F.lit(0)})
    for level, side in enumerate(CELLS):
        ratio = CELLS[level - 1] // side if level else None
        axes = []
        for at, size in (("ty", "h"), ("tx", "w")):
            low = F.col(at) * ratio if ratio else F.lit(0)
            high = F.floor((F.col(size) - 1) / side).cast("int")
            axes.append(F.sequence(low, F.least(low + ratio - 1, high) if ratio else high))
        now = now.withColumn("ty", F.explode(axes[0])).withColumn("tx", F.explode(axes[1]))
        near, far = F.lit(0.0), F.lit(0.0)
        for seed, at, size in (("cy", "ty", "h"), ("cx", "tx", "w")):
            low = F.col(at) * side
            high = F.least(low + side, F.col(size)) - 1
            out = F.greatest(low - F.col(seed), F.col(seed) - high, F.lit(0.0))
            most = F.greatest(F.abs(F.col(seed) - low), F.abs(F.col(seed) - high))
            near, far = near + out * out, far + most * most
        bound = F.min(far).over(Window.partitionBy("fov", "ty", "tx"))
        now = now.withColumns({"near": near, "bound": bound}).where(F.col("near") <= F.col("bound") * (1 + 1e-9) + 1e-9).drop("near", "bound")
    return now.select("fov", "ty", "tx", "idx", "class", "cx", "cy")


def class_regions(px: DataFrame, seeds: DataFrame, ext: DataFrame) -> DataFrame:
    """``px`` with the class of the nearest seed (fov, idx, class, cx, cy; x is the column), ties to the smaller idx; pixels of fovs without seeds are left out.

    A pixel meets the candidates of its tile only, and is given its class where they met it.
    """
    side = CELLS[-1]
    tiled = px.select(*PX, F.floor(F.col("r") / side).cast("int").alias("ty"), F.floor(F.col("c") / side).cast("int").alias("tx"))
    met = tiled.join(shuffled(candidates(seeds, ext)), ["fov", "ty", "tx"])
    far = (F.col("c") - F.col("cx")) * (F.col("c") - F.col("cx")) + (F.col("r") - F.col("cy")) * (F.col("r") - F.col("cy"))
    best = met.groupBy("fov", "ty", "tx", "r", "c").agg(F.min(F.struct(far.alias("d2"), F.col("idx"), F.col("class"))).alias("s"))
    return best.select(*PX, F.col("s.class").alias("class"))


def finite_regions(seeds: DataFrame, ext: DataFrame) -> DataFrame:
    """(fov, idx, class, ring): the Voronoi cell of each seed as a closed ring of whole pixels, endless cells closed far out (see finite_cells), corners moved into the image
    and then cut to whole numbers. Fovs whose seeds are all in line, or fewer than three, have none. A task triangulates the seeds of one fov."""

    def work(own: dict) -> list[tuple]:
        cells = finite_cells(own["cx"], own["cy"])
        h, w = int(own["h"][0]), int(own["w"][0])
        out = []
        for idx, class_, cell in zip(own["idx"].tolist(), own["class"].tolist(), cells or []):
            xs, ys = np.clip(cell[:, 0], 0, w - 1).astype(np.int64).tolist(), np.clip(cell[:, 1], 0, h - 1).astype(np.int64).tolist()
            if len(xs) >= 3:
                out.append((idx, class_, [*xs, xs[0]], [*ys, ys[0]]))
        return out

    rows = seeds.select("fov", "idx", "class", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).join(ext, "fov")
    found = by_group(rows, ["fov"], ["idx"], work, "idx int, class string, xs array<int>, ys array<int>")
    return found.select("fov", "idx", "class", F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).cast(RING).alias("ring"))


def clamped_regions(seeds: DataFrame, ext: DataFrame) -> DataFrame:
    """(fov, class, r, c): pixels inside or on the finite cells of each class's seeds. Cells share their outlines, so a pixel may be in the regions of several classes; and
    where corners were moved into the image, in none."""
    return fill(finite_regions(seeds, ext), "fov", "idx", "class").select("fov", "class", "r", "c").distinct()
