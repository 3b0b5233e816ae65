"""Exact distances to the nearest source, at a cost that the reach does not change: runs along each row, then the lower envelope of parabolas down each column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TALL, WIDE = 512, 512  # rows and columns of a block
_FAR = 1 << 62


def owned(sources: DataFrame, ext: DataFrame, reach: int, *keys: str) -> DataFrame:
    """(keys, fov, r, c0, c1, label, lo, hi, h, w): runs of sources of equal labels along a row, and the columns lo to hi to which one of them is nearest in that row, of
    two as near the one before. Of several sources at a pixel that of the least label counts. One shuffle, by row."""
    row = [*keys, "fov", "r"]
    rows = sources.select(*row, "c", "label").repartition(*row).groupBy(*row, "c").agg(F.min("label").alias("label"))
    own = Window.partitionBy(*row).orderBy("c")
    goes_on = (F.lag("c").over(own) == F.col("c") - 1) & F.lag("label").over(own).eqNullSafe(F.col("label"))
    marked = rows.withColumn("first", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("first").over(own))
    found = marked.groupBy(*row, "run").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.first("label").alias("label"))
    by = Window.partitionBy(*row).orderBy("c0")
    low, high = F.floor((F.lag("c1").over(by) + F.col("c0")) / 2) + 1, F.floor((F.col("c1") + F.lead("c0").over(by)) / 2)
    met = found.withColumns({"lo": F.coalesce(low, F.lit(0)), "hi": F.coalesce(high, F.lit(1 << 30))}).join(ext, "fov")
    lo, hi = F.greatest("lo", F.col("c0") - reach, F.lit(0)), F.least("hi", F.col("c1") + reach, F.col("w") - 1)
    return met.select(*row, "c0", "c1", "label", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "h", "w").where(F.col("lo") <= F.col("hi"))


class Envelope:
    """The lower envelopes of parabolas (y - r)^2 + g, one for each of several columns; parabolas come by ascending r. Whole numbers, so ties are exact: of two
    parabolas as low the earlier counts."""

    def __init__(self, columns: int, deepest: int):
        self.top = np.full(columns, -1)
        self.which = np.zeros((deepest, columns), dtype=np.int64)  # number of the parabola
        self.start = np.zeros((deepest, columns), dtype=np.int64)  # the first y where it is lowest

    def add(self, rows: np.ndarray, heights: np.ndarray) -> None:
        """Parabolas at ``rows``, with a height for each column; those of _FAR are left out."""
        for k in range(len(rows)):
            self._push(np.flatnonzero(heights[k] < _FAR), k, heights, rows)

    def _push(self, cols: np.ndarray, k: int, heights: np.ndarray, rows: np.ndarray) -> None:
        todo, r, g = cols, rows[k], heights[k]
        begin = np.full(len(g), -_FAR)
        while len(todo):
            todo = todo[self.top[todo] >= 0]
            level = self.top[todo]
            other = self.which[level, todo]
            ro = rows[other]
            at = (r * r - ro * ro + g[todo] - heights[other, todo]) // (2 * (r - ro)) + 1
            beaten = at <= self.start[level, todo]
            begin[todo[~beaten]] = at[~beaten]
            todo = todo[beaten]
            self.top[todo] -= 1
        self.top[cols] += 1
        self.which[self.top[cols], cols] = k
        self.start[self.top[cols], cols] = begin[cols]

    def lowest(self, low: int, high: int) -> np.ndarray:
        """(high - low, columns): the number of the parabola that is lowest at each y from low on; -1 where there is none."""
        out = np.full((high - low, len(self.top)), -1)
        at, cols = np.zeros(len(self.top), dtype=np.int64), np.flatnonzero(self.top >= 0)
        for y in range(low, high):
            todo = cols
            while len(todo):
                todo = todo[at[todo] < self.top[todo]]
                todo = todo[self.start[at[todo] + 1, todo] <= y]
                at[todo] += 1
            out[y - low, cols] = self.which[at[cols], cols]
        return out


def _nearest(px: pd.DataFrame, reach: int, tall: int, wide: int) -> dict:
    """Arrays r, c, d2, sr, sc and label of the pixels of one block of tall x wide, of 0 < d2 <= reach^2."""
    y0, x0, h, w = (int(px[k].iloc[0]) for k in ("y0", "x0", "h", "w"))
    r = px["r"].to_numpy().astype(np.int64)
    left, right = max(x0, int(px["lo"].min())), min(x0 + wide - 1, int(px["hi"].max()), w - 1)
    low, high = max(y0, int(r.min()) - reach), min(y0 + tall, h, int(r.max()) + reach + 1)
    rows, at = np.unique(r, return_inverse=True)
    cols = right - left + 1
    heights, source, owner = np.full((len(rows), cols), _FAR), np.zeros((len(rows), cols), dtype=np.int64), np.zeros((len(rows), cols), dtype=np.int64)
    lo, hi = np.maximum(px["lo"].to_numpy().astype(np.int64), left), np.minimum(px["hi"].to_numpy().astype(np.int64), right)
    n = np.maximum(hi - lo + 1, 0)
    i = np.repeat(np.arange(len(px)), n)
    x = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    sc = np.clip(x, px["c0"].to_numpy().astype(np.int64)[i], px["c1"].to_numpy().astype(np.int64)[i])
    place = (at[i], x - left)
    heights[place], source[place], owner[place] = (x - sc) ** 2, sc, i
    env = Envelope(cols, len(rows))
    env.add(rows, heights)
    best = env.lowest(low, high)
    y, c = np.nonzero(best >= 0)
    k = best[y, c]
    d2 = (y + low - rows[k]) ** 2 + heights[k, c]
    met = (d2 > 0) & (d2 <= reach * reach)
    y, c, k, d2 = y[met], c[met], k[met], d2[met]
    return {"r": (y + low).astype(np.int32), "c": (c + left).astype(np.int32), "d2": d2, "sr": rows[k].astype(np.int32), "sc": source[k, c].astype(np.int32), "label": px["label"].to_numpy()[owner[k, c]]}


def transform(sources: DataFrame, ext: DataFrame, reach: int, *keys: str) -> DataFrame:
    """(keys, fov, r, c, d2, sr, sc, label): for each pixel outside the sources (keys, fov, r, c, perhaps label) and within reach, the nearest source, ties to the first in
    raster order. Sources of other ``keys`` are apart.

    Blocks are of TALL rows, or of the reach if that is more, and of WIDE columns. A block sees the rows within reach of it, so it handles at most three times its own rows
    whatever the reach.
    """
    lab = F.col("label") if "label" in sources.columns else F.lit(1)
    found = owned(sources.select(*keys, "fov", "r", "c", lab.alias("label")), ext, reach, *keys)
    tall, wide = max(TALL, reach), WIDE
    up, down = F.greatest(F.floor((F.col("r") - reach) / tall), F.lit(0)), F.floor(F.least(F.col("r") + reach, F.col("h") - 1) / tall)
    dealt = found.withColumn("y0", F.explode(F.sequence(up, down))).withColumn("x0", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide))))
    dealt = dealt.withColumns({"y0": (F.col("y0") * tall).cast("int"), "x0": (F.col("x0") * wide).cast("int")})
    own = [*keys, "fov"]

    def work(px: pd.DataFrame) -> pd.DataFrame:
        made = _nearest(px, reach, tall, wide)
        return pd.DataFrame({**{k: pd.Series([px[k].iloc[0]] * len(made["r"]), dtype=px[k].dtype) for k in own}, **made})

    fixed = [T.StructField(n, T.LongType() if n == "d2" else T.IntegerType()) for n in ("r", "c", "d2", "sr", "sc")]
    kinds = T.StructType([*(found.schema[k] for k in own), *fixed, T.StructField("label", found.schema["label"].dataType)])
    return dealt.groupBy(*own, "y0", "x0").applyInPandas(work, kinds)
