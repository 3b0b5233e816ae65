"""Perimeter and solidity of labelled objects."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.operators.groups import by_group
from densigrid.operators.hulls import convex

# Weight of a border pixel by the code of its 3 x 3 window (1 at the centre, 2 at edges, 10 at corners).
STRAIGHT, SLANTED, MIXED = (5, 7, 15, 17, 25, 27), (21, 33), (13, 23)


def border(labelled: DataFrame) -> DataFrame:
    """Pixels of which one of the four neighbours is not of the same object."""
    sides = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))))
    rows = labelled.select("fov", "label", "r", "c", F.explode(sides).alias("d"))
    met = rows.groupBy("fov", "label", (F.col("r") + F.col("d.y")).alias("r"), (F.col("c") + F.col("d.x")).alias("c"))
    own = F.max(F.when((F.col("d.y") == 0) & (F.col("d.x") == 0), 1).otherwise(0))
    return met.agg(F.count(F.lit(1)).alias("n"), own.alias("own")).where((F.col("own") == 1) & (F.col("n") < 5)).select("fov", "label", "r", "c")


def perimeters(labelled: DataFrame) -> DataFrame:
    """(fov, label, perimeter) of every object of (fov, label, r, c): the length of its border, estimated from each border pixel's window."""
    edge = border(labelled)
    moves = [(y, x, 1 if y == x == 0 else 10 if y and x else 2) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    window = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w")) for y, x, w in moves))
    spread = edge.select("fov", "label", "r", "c", F.explode(window).alias("d"))
    codes = spread.groupBy("fov", "label", (F.col("r") + F.col("d.y")).alias("r"), (F.col("c") + F.col("d.x")).alias("c")).agg(
        F.sum("d.w").alias("code"), F.max((F.col("d.w") == 1).cast("int")).alias("own")).where(F.col("own") == 1)
    weight = F.when(F.col("code").isin(*STRAIGHT), 1.0).when(F.col("code").isin(*SLANTED), math.sqrt(2)).when(F.col("code").isin(*MIXED), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return codes.groupBy("fov", "label").agg(F.sum(weight).alias("perimeter"))


def hull_pixels(r: np.ndarray, c: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the middles of all pixels' sides."""
    # The ends of each row bound the hull; doubled coordinates keep all in whole numbers.
    order = np.lexsort((c, r))
    rr, cc = r[order].astype(np.int64), c[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, rr[1:] != rr[:-1]])
    last = np.r_[first[1:], len(rr)] - 1
    ends = 2 * np.concatenate([np.column_stack([rr[first], cc[first]]), np.column_stack([rr[last], cc[last]])])
    ring = np.array(convex(np.unique(np.concatenate([ends + d for d in ((0, 1), (0, -1), (1, 0), (-1, 0))]), axis=0)))
    rows = 2 * np.arange(rr.min(), rr.max() + 1)
    low, high = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    for (y0, x0), (y1, x1) in zip(ring, np.roll(ring, -1, axis=0)):
        if y0 != y1:
            hit = (rows >= min(y0, y1)) & (rows <= max(y0, y1))
            x = x0 + (rows[hit] - y0) * ((x1 - x0) / (y1 - y0))
            low[hit], high[hit] = np.minimum(low[hit], x), np.maximum(high[hit], x)
    return int((np.floor(high / 2 + 1e-9) - np.ceil(low / 2 - 1e-9) + 1).clip(0).sum())


def solidities(labelled: DataFrame) -> DataFrame:
    """(fov, label, solidity): area over the pixels of the convex hull. Only the ends of each object's rows are gathered, not its pixels."""
    ends = labelled.groupBy("fov", "label", "r").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"))

    def work(row: dict) -> list[tuple]:
        whole = hull_pixels(np.concatenate([row["r"], row["r"]]), np.concatenate([row["c0"], row["c1"]]))
        return [(float(row["n"].sum() / whole),)]

    return by_group(ends, ["fov", "label"], ["r"], work, "solidity double")
