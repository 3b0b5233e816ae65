"""Points near points: counts within a radius by tiles, clusters by density, and their outlines. Points that share a place are one site.

Sites are dealt once, to tiles of many cells with a narrow edge of their neighbours' sites; pairs in reach are made and counted within a tile and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densigrid.operators import hulls
from densigrid.operators.contours import RING, region_contours, trace_runs
from densigrid.operators.groups import by_group
from densigrid.operators.raster import shuffled, threshold
from densigrid.operators.runs import least_roots
from densigrid.sources.stage import staged

SITE = ["fov", "r", "c"]
PAIRS = 1 << 20  # pairs of places tried at a time


def sites(points: DataFrame) -> DataFrame:
    """(fov, r, c, m, first): places, how many points (fov, id, r, c) each holds, and the least id."""
    return points.groupBy(*SITE).agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first"))


def _cells(radius: float) -> tuple[float, int]:
    """The side of a cell, within which all places are in reach of each other, and how many cells a tile's side has: about 1,024 pixels, if the radius allows."""
    side = radius / math.sqrt(2)
    return side, int(min(256, max(16, 1024 // side)))


def _dealt(own: DataFrame, radius: float, reach: int) -> DataFrame:
    """Sites with their cell (y, x), dealt to their tile (ty, tx) and to the tiles that they lie within ``reach`` cells of; few are dealt more than once."""
    side, wide = _cells(radius)
    cells = own.withColumns({to: F.floor(F.col(at) / side).cast("long") for at, to in (("r", "y"), ("c", "x"))})
    around = lambda n: F.explode(F.sequence(F.floor((F.col(n) - reach) / wide), F.floor((F.col(n) + reach) / wide)))
    return cells.withColumn("ty", around("y")).withColumn("tx", around("x"))


def _within(px: pd.DataFrame, beyond: int, wide: int) -> np.ndarray:
    """Which sites of a tile's rows are in it, or in no more than so many cells beyond it."""
    y, x, ty, tx = (px[k].to_numpy() for k in ("y", "x", "ty", "tx"))
    return (y >= ty * wide - beyond) & (y < (ty + 1) * wide + beyond) & (x >= tx * wide - beyond) & (x < (tx + 1) * wide + beyond)


def _near(px: pd.DataFrame, of: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): rows of ``of`` and all rows of ``px``, sorted by cell, that are no farther apart than the radius, themselves among them. About PAIRS are tried at a time."""
    y, x, r, c = (px[k].to_numpy() for k in ("y", "x", "r", "c"))
    r, c = (v.astype(np.int64) if v.dtype.kind in "iu" else v.astype(float) for v in (r, c))
    wide = int(x.max() - x.min()) + 5
    code = (y - y.min() + 2) * wide + (x - x.min() + 2)
    every = np.flatnonzero(of)
    for dy in range(-2, 3):  # places in reach are two cells apart at most
        low, high = (np.searchsorted(code, code[every] + (dy * wide + dx), side) for dx, side in ((-2, "left"), (2, "right")))
        n = high - low
        ends, at = np.cumsum(n), 0
        while at < len(every):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            m = n[at:to]
            i = np.repeat(every[at:to], m)
            j = np.repeat(low[at:to], m) + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            met = (r[i] - r[j]) * (r[i] - r[j]) + (c[i] - c[j]) * (c[i] - c[j]) <= radius * radius
            yield i[met], j[met]
            at = to


def _counts(px: pd.DataFrame, of: np.ndarray, radius: float) -> np.ndarray:
    """Points within the radius of each row of ``of``; 0 for other rows."""
    m, n = px["m"].to_numpy(), np.zeros(len(px))
    for i, j in _near(px, of, radius):
        n += np.bincount(i, weights=m[j], minlength=len(px))
    return n.astype(np.int64)


def _crowd(own: DataFrame, radius: float) -> DataFrame:
    """Sites (fov, r, c, m) with n, the points within the radius, their own among them. A task holds one tile's sites."""
    _, wide = _cells(radius)

    def work(px: pd.DataFrame) -> pd.DataFrame:
        px = px.sort_values(["y", "x"], ignore_index=True)
        mine = _within(px, 0, wide)
        return px.assign(n=_counts(px, mine, radius))[mine][[*SITE, "n"]]

    rows = _dealt(own.select(*SITE, "m"), radius, 2)
    return rows.groupBy("fov", "ty", "tx").applyInPandas(work, T.StructType([*(own.schema[k] for k in SITE), T.StructField("n", T.LongType())]))


def neighbor_count(points: DataFrame, radius: float) -> DataFrame:
    """(fov, id, r, c, n): points within the radius, itself among them."""
    return points.select("fov", "id", "r", "c").join(shuffled(_crowd(sites(points), radius).select(*SITE, "n")), SITE).select("fov", "id", "r", "c", "n")


def neighbor_raster(points: DataFrame, radius: float) -> DataFrame:
    """The count at each pixel, places rounded half to even; where points of different places share one, that of the last id."""
    at = lambda x: F.rint(x).cast("int").alias(x)
    return neighbor_count(points, radius).groupBy("fov", at("r"), at("c")).agg(F.max_by("n", "id").alias("v"))


def dense_points(points: DataFrame, radius: float, more_than: int) -> DataFrame:
    return neighbor_count(points, radius).where(F.col("n") > more_than)


def dbscan(points: DataFrame, radius: float, min_samples: int) -> DataFrame:
    """(fov, id, r, c, cluster): clusters from 0 by their first id, -1 for noise; a border point goes with the core of least id in reach.

    Core sites of one cell, of a side of radius / sqrt(2), are always joined. A tile joins its cells with cores, and names what it has joined by a cell of its own; only the
    cells that neighbouring tiles see meet by fov, and tell which of these names are one cluster.
    """
    _, wide = _cells(radius)
    none = F.col("first").isNull()
    kind = points.schema["id"].dataType
    own = sites(points).select(*SITE, "m", none.alias("none"), F.coalesce("first", F.lit(0).cast(kind)).alias("first"))
    longs = ["y", "x", "y2", "x2"]
    schema = T.StructType([*(own.schema[k] for k in (*SITE, "none", "first")), *(T.StructField(k, T.LongType()) for k in longs), T.StructField("site", T.BooleanType())])

    def work(px: pd.DataFrame) -> pd.DataFrame:
        """The tile's sites with the name (y, x) of their cluster, and pairs of a name and a cell with cores (y2, x2) that another tile sees too."""
        px = px.sort_values(["none", "first", "y", "x"], ascending=[False, True, True, True], ignore_index=True)
        px = px.assign(rank=np.arange(len(px))).sort_values(["y", "x"], ignore_index=True)
        mine, seen = _within(px, 0, wide), _within(px, 2, wide)
        core = seen & (_counts(px, seen, radius) >= min_samples)
        y, x, rank = (px[k].to_numpy() for k in ("y", "x", "rank"))
        new = np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])]
        cell, first = np.cumsum(new) - 1, np.flatnonzero(new)
        least = np.full(len(px), len(px))
        ends = [np.zeros(0, dtype=np.int64)]
        for i, j in _near(px, mine, radius):
            i, j = i[core[j]], j[core[j]]
            np.minimum.at(least, i, rank[j])
            joined = core[i] & (cell[i] != cell[j])
            ends.append(np.unique(cell[i[joined]] * len(first) + cell[j[joined]]))
        links = np.unique(np.concatenate(ends))
        top = least_roots(len(first), links // len(first), links % len(first))
        # a name is the least of the tile's own cells among those joined; cells that none of these joins keep their own
        own_cell = mine[first]
        low = np.full(len(first), len(first))
        np.minimum.at(low, top[own_cell], np.flatnonzero(own_cell))
        name = np.where(low[top] < len(first), low[top], np.arange(len(first)))
        at_rank = np.empty(len(px), dtype=np.int64)
        at_rank[rank] = np.arange(len(px))
        member = np.flatnonzero(mine & (least < len(px)))
        of = first[name[cell[at_rank[least[member]]]]]
        found = px.iloc[member][[*SITE, "none", "first"]].assign(y=y[of], x=x[of], y2=0, x2=0, site=True)
        # cells with cores on either side of the tile's edge
        shared = np.unique(cell[core & ~_within(px, -2, wide)])
        shared = shared[name[shared] != shared]
        met = first[shared]
        named = first[name[shared]]
        pairs = px.iloc[met][[*SITE, "none", "first"]].assign(y=y[named], x=x[named], y2=y[met], x2=x[met], site=False)
        return pd.concat([found, pairs], ignore_index=True)

    tiles = staged(_dealt(own, radius, 4).groupBy("fov", "ty", "tx").applyInPandas(work, schema))

    def over_tiles(rows: pd.DataFrame) -> pd.DataFrame:
        ys, xs = (np.concatenate([rows[a].to_numpy(), rows[b].to_numpy()]) for a, b in (("y", "y2"), ("x", "x2")))
        across = int(xs.max() - xs.min()) + 1
        cells, node = np.unique((ys - ys.min()) * across + (xs - xs.min()), return_inverse=True)
        top = cells[least_roots(len(cells), node[: len(rows)], node[len(rows):])]
        return pd.DataFrame({"fov": np.repeat(rows["fov"].to_numpy()[:1], len(cells)), "y": cells // across + ys.min(), "x": cells % across + xs.min(), "ty": top // across + ys.min(), "tx": top % across + xs.min()})

    same = tiles.where(~F.col("site")).select("fov", *longs).groupBy("fov").applyInPandas(over_tiles, T.StructType([own.schema["fov"], *(T.StructField(k, T.LongType()) for k in ("y", "x", "ty", "tx"))]))
    member = tiles.where("site").join(shuffled(same), ["fov", "y", "x"], "left").select(*SITE, F.when(~F.col("none"), F.col("first")).alias("first"), F.coalesce("ty", "y").alias("y"), F.coalesce("tx", "x").alias("x"))
    named = member.groupBy("fov", "y", "x").agg(F.min("first").alias("least"))
    named = named.select("fov", "y", "x", (F.row_number().over(Window.partitionBy("fov").orderBy("least")) - 1).alias("cluster"))
    placed = member.join(shuffled(named), ["fov", "y", "x"]).select(*SITE, "cluster")
    return points.select("fov", "id", "r", "c").join(shuffled(placed), SITE, "left").select("fov", "id", "r", "c", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_circles(clustered: DataFrame, radius: float) -> DataFrame:
    """Centre, and the distance to the farthest member or half the radius, whichever is more."""
    kept = clustered.where(F.col("cluster") >= 0)
    middle = kept.groupBy("fov", "cluster").agg(F.avg("r").alias("cy"), F.avg("c").alias("cx"), F.count(F.lit(1)).alias("n"))
    far = F.max(F.sqrt((F.col("r") - F.col("cy")) ** 2 + (F.col("c") - F.col("cx")) ** 2))
    return kept.join(shuffled(middle), ["fov", "cluster"]).groupBy("fov", "cluster", "cy", "cx", "n").agg(F.greatest(far, F.lit(float(radius // 2))).alias("radius"))


def circle_runs(circles: DataFrame, ext: DataFrame) -> DataFrame:
    """(fov, cluster, r, c0, c1) of the discs around the circles' centres, both centre and radius cut to whole pixels, within the image."""
    whole = lambda x: F.col(x).cast("int")
    at = circles.join(ext, "fov").select("fov", "cluster", "h", "w", whole("cy").alias("y"), whole("cx").alias("x"), whole("radius").alias("k"))
    rows = at.withColumn("r", F.explode(F.sequence(F.greatest(F.col("y") - F.col("k"), F.lit(0)), F.least(F.col("y") + F.col("k"), F.col("h") - 1))))
    k, up = F.col("k").cast("long"), (F.col("r") - F.col("y")).cast("long")
    half = F.floor(F.sqrt(k * k - up * up)).cast("int")
    return rows.select("fov", "cluster", "r", F.greatest(F.col("x") - half, F.lit(0)).alias("c0"), F.least(F.col("x") + half, F.col("w") - 1).alias("c1"))


def _row_ends(clustered: DataFrame) -> DataFrame:
    """The first and last points of each cluster's rows; no other point can be on a convex hull."""
    ends = clustered.where(F.col("cluster") >= 0).groupBy("fov", "cluster", "r").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("n"))
    return ends.select("fov", "cluster", "r", F.explode(F.array("a", "b")).alias("c"))


def _outlines(points: DataFrame, outline) -> DataFrame:
    """(fov, cluster, ring): what ``outline`` makes of each cluster's distinct points (x, y), as a closed ring; clusters without one are left out."""

    def work(px: dict) -> list[tuple]:
        ring = outline(np.unique(np.column_stack([px["c"], px["r"]]), axis=0))
        return [([int(x) for x, _ in (*ring, ring[0])], [int(y) for _, y in (*ring, ring[0])])] if len(ring) >= 3 else []

    found = by_group(points.select("fov", "cluster", "r", "c"), ["fov", "cluster"], ["c", "r"], work, "xs array<int>, ys array<int>")
    return found.select("fov", "cluster", F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).cast(RING).alias("ring"))


def convex_hulls(clustered: DataFrame) -> DataFrame:
    """(fov, cluster, ring): closed convex rings (x = column, y = row) of clusters of three places or more that are not in line."""
    return _outlines(_row_ends(clustered), lambda at: hulls.convex(at))


def concave_hulls(clustered: DataFrame, alpha: float) -> DataFrame:
    """(fov, cluster, ring): outer rings of the union of Delaunay triangles with a circumradius under 1 / alpha; the convex hull for an alpha of 0.

    Clusters whose triangles fall apart, or that keep none, have no ring. A task holds one cluster's places.
    """
    if alpha <= 0:
        return convex_hulls(clustered)
    return _outlines(clustered.where(F.col("cluster") >= 0).select("fov", "cluster", "r", "c").distinct(), lambda at: hulls.concave(at, alpha))


def cluster_contours(clustered: DataFrame, ext: DataFrame, kind: str, radius: float, alpha: float = 0.1) -> DataFrame:
    """(fov, cluster, ring) around clusters: simple_circle, complex_hull (convex) or concave_hull."""
    if kind == "simple_circle":
        traced = trace_runs(circle_runs(cluster_circles(clustered, radius), ext), "cluster")
        return traced.where(~F.col("hole")).select("fov", "cluster", "ring")
    if kind == "complex_hull":
        return convex_hulls(clustered)
    if kind == "concave_hull":
        return concave_hulls(clustered, alpha)
    raise ValueError(f"unknown kind of contour {kind!r}")


def contours_from_neighbors(points: DataFrame, ext: DataFrame, radius: float, limit: float, least: float, direction: str = "higher", raster: DataFrame | None = None) -> DataFrame:
    """Contours of where the neighbour count (or a raster made of it, say an inpainted one) is above or below the limit."""
    counts = neighbor_raster(points, radius) if raster is None else raster
    return region_contours(threshold(counts, ext, limit, direction), counts, least)
