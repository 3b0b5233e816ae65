"""Masks as runs of pixels along rows: components without a task that holds a field of view.

Tiles, parts of ``PART`` columns of strips of ``STRIP`` rows, are labelled apart, and runs end where a tile does. Only the runs on either side of a tile's edge meet in one task a
fov, which joins the components of neighbouring tiles; components are numbered by counts of rows, so no task holds all of a fov's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densigrid.operators.raster import shuffled
from densigrid.sources.stage import staged

STRIP, PART = 512, 2048
TILE = ["fov", "strip", "part"]
_WIDE = 1 << 31


def _strip() -> Column:
    return F.floor(F.col("r") / STRIP).cast("int")


def _part(column: str) -> Column:
    return F.floor(F.col(column) / PART).cast("int")


def numbered(rows: DataFrame, row: Column, name: str, *order: str) -> DataFrame:
    """``rows`` with a number from 1 by fov, in the order of the image row that ``row`` tells and then of ``order``. A task numbers an image row's, and only the counts of
    rows meet by fov. ``rows`` are read twice."""
    by_row = rows.withColumn("_row", row)
    counts = by_row.groupBy("fov", "_row").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("fov", "_row", (F.sum("_n").over(Window.partitionBy("fov").orderBy("_row")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("fov", "_row").orderBy(*order))
    return by_row.withColumn("_at", at).join(shuffled(before), ["fov", "_row"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_row", "_at", "_before")


def runs(px: DataFrame) -> DataFrame:
    """(fov, strip, part, r, c0, c1) of distinct pixels (fov, r, c); with a column value, runs are of equal values and keep it. Runs end with their tile. One shuffle."""
    more = ["value"] if "value" in px.columns else []
    own = Window.partitionBy(*TILE).orderBy("r", "c")
    follows = (F.lag("r").over(own) == F.col("r")) & (F.lag("c").over(own) == F.col("c") - 1)
    for v in more:
        follows = follows & F.lag(v).over(own).eqNullSafe(F.col(v))
    marked = px.select("fov", _strip().alias("strip"), _part("c").alias("part"), "r", "c", *more).withColumn("first", F.when(follows, 0).otherwise(1))
    return marked.withColumn("run", F.sum("first").over(own)).groupBy(*TILE, "run", "r", *more).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("run")


def gaps(mask: DataFrame, ext: DataFrame) -> DataFrame:
    """Runs of what is not in the mask, in the image and a frame of one pixel around it. Pixels of the background are never made. Runs end with their tile."""
    rows = ext.select("fov", "w", F.explode(F.sequence(F.lit(-1), F.col("h"))).alias("r"))
    ends = rows.select("fov", "r", F.explode(F.array(F.lit(-2), F.col("w") + 1)).alias("c"))
    own = Window.partitionBy("fov", "r").orderBy("c")
    met = mask.select("fov", "r", "c").union(ends).withColumn("before", F.lag("c").over(own))
    return cut(met.where(F.col("c") - F.col("before") > 1).select("fov", _strip().alias("strip"), "r", (F.col("before") + 1).alias("c0"), (F.col("c") - 1).alias("c1")))


def cut(found: DataFrame, reach: int = 0) -> DataFrame:
    """Runs (r, c0, c1 and other columns) with the part that they lie in, in as many pieces as they have parts; with a ``reach`` a part also has so many columns beyond its edges."""
    parts = F.sequence(F.floor((F.col("c0") - reach) / PART).cast("int"), F.floor((F.col("c1") + reach) / PART).cast("int"))
    rows = found.withColumn("part", F.explode(parts))
    low, high = F.col("part").cast("long") * PART - reach, (F.col("part").cast("long") + 1) * PART - 1 + reach
    return rows.withColumns({"c0": F.greatest(F.col("c0"), low).cast("int"), "c1": F.least(F.col("c1"), high).cast("int")})


def touching(r: np.ndarray, c0: np.ndarray, c1: np.ndarray, value: np.ndarray | None, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of runs, sorted by row and column, of which j is in the row above i and touches it; of equal values, if there are any."""
    if not len(r):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    r, c0, c1 = (x.astype(np.int64) for x in (r, c0, c1))
    low = c0.min()
    wide, reach = int(c1.max() - low) + 4, 1 if eight else 0
    row = r - r.min() + 1
    at = lambda y, x: y * wide + (x - low) + 1
    lo = np.searchsorted(at(row, c1), at(row - 1, c0) - reach, "left")
    hi = np.searchsorted(at(row, c0), at(row - 1, c1) + reach, "right")
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(r)), n)
    j = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same = slice(None) if value is None else value[i] == value[j]
    return i[same], j[same]


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (a, b) join it to, by hooking roots and pointer jumping on whole arrays."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]
    return root


def label_runs(found: DataFrame, eight: bool = True) -> DataFrame:
    """``found`` (fov, strip, part, r, c0, c1 and perhaps value) with label and area: components, of equal values only, numbered from 1 by fov in raster order, and their pixels.

    A tile's runs are written with the first run of their component in the tile. Those at tiles' edges tell which of these components are one; the others are whole.
    """
    fov = found.schema["fov"].dataType.simpleString()

    def values(rows: pd.DataFrame) -> np.ndarray | None:
        return pd.factorize(rows["value"], use_na_sentinel=False)[0] if "value" in rows else None

    def rooted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "c0"], ignore_index=True)
        r, c0, c1 = (rows[k].to_numpy().astype(np.int64) for k in ("r", "c0", "c1"))
        value = values(rows)
        i, j = touching(r, c0, c1, value, eight)
        # runs of one row that were handed in apart, or begin where another ends
        beside = np.flatnonzero((r[1:] == r[:-1]) & (c0[1:] == c1[:-1] + 1) & (True if value is None else value[1:] == value[:-1])) if len(r) else i
        top = least_roots(len(rows), np.r_[i, beside + 1], np.r_[j, beside])
        size = np.bincount(top, weights=c1 - c0 + 1, minlength=len(rows)).astype(np.int64)
        return rows.assign(root=(r[top] + 1) * _WIDE + c0[top] + 1, size=size[top])

    def over_tiles(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "c0"], ignore_index=True)
        names, first, node = np.unique(rows["root"].to_numpy(), return_index=True, return_inverse=True)
        r, c0, c1 = (rows[k].to_numpy().astype(np.int64) for k in ("r", "c0", "c1"))
        value = values(rows)
        i, j = touching(r, c0, c1, value, eight)
        beside = np.flatnonzero((r[1:] == r[:-1]) & (c0[1:] == c1[:-1] + 1) & (True if value is None else value[1:] == value[:-1]))
        top = least_roots(len(names), node[np.r_[i, beside + 1]], node[np.r_[j, beside]])
        area = np.bincount(top, weights=rows["size"].to_numpy()[first], minlength=len(names)).astype(np.int64)
        return pd.DataFrame({"fov": pd.Series([rows["fov"].iloc[0]] * len(names), dtype=object), "root": names, "top": names[top], "whole": area[top]})

    of = lambda *more: T.StructType([*(f for f in found.schema.fields), *(T.StructField(n, t) for n, t in more)])
    tiles = staged(found.groupBy(*TILE).applyInPandas(rooted, of(("root", T.LongType()), ("size", T.LongType()))))
    at_row, at_column = F.pmod("r", F.lit(STRIP)), lambda c: F.pmod(F.col(c), F.lit(PART))
    edge = at_row.isin(0, STRIP - 1) | (at_column("c0") == 0) | (at_column("c1") == PART - 1)
    joined = tiles.where(edge).groupBy("fov").applyInPandas(over_tiles, f"fov {fov}, root long, top long, whole long")
    own = tiles.where((F.col("r").cast("long") + 1) * _WIDE + F.col("c0") + 1 == F.col("root")).select("fov", "root", "size")
    parts = staged(own.join(shuffled(joined), ["fov", "root"], "left").select("fov", "root", F.coalesce("top", "root").alias("top"), F.coalesce("whole", "size").alias("area")))
    label = numbered(parts.where(F.col("root") == F.col("top")).select("fov", "top"), F.floor(F.col("top") / _WIDE), "label", "top")
    names = parts.join(shuffled(label), ["fov", "top"]).select("fov", "root", "label", "area")
    rest = [c for c in found.columns if c not in ("strip", "part")]
    return tiles.join(shuffled(names), ["fov", "root"]).select(*rest, "label", "area")


def pixels(found: DataFrame) -> DataFrame:
    """The pixels (r, c) of runs, other columns kept."""
    rest = [c for c in found.columns if c not in ("strip", "part", "r", "c0", "c1", "fov", "area")]
    return found.select("fov", "r", F.explode(F.sequence("c0", "c1")).alias("c"), *rest)
