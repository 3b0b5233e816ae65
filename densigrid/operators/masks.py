"""Masks as sets of pixels (fov, r, c): set algebra, morphology, components, holes and area filters."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.operators.raster import PX, absent, inside, shuffled
from densigrid.operators.runs import gaps, label_runs, least_roots, pixels, runs, touching


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PX)
    for m in masks[1:]:
        out = out.union(m.select(*PX))
    return out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PX).join(shuffled(b.select(*PX)), PX, "left_semi")


def subtract(base: DataFrame, *others: DataFrame) -> DataFrame:
    return base.select(*PX).join(shuffled(union(*others)), PX, "left_anti")


def complement(mask: DataFrame, ext: DataFrame) -> DataFrame:
    return absent(mask, ext)


def transpose(mask: DataFrame) -> DataFrame:
    return mask.select("fov", F.col("c").alias("r"), F.col("r").alias("c"))


def _along(px: DataFrame, at: str) -> tuple[DataFrame, list[str]]:
    """Runs a to b of pixels (fov, r, c, h, w) along one axis, and what they share. A line of pixels is dealt as one, and nothing is spread."""
    line = ["fov", "c" if at == "r" else "r"]
    own = Window.partitionBy(*line).orderBy(at)
    marked = px.withColumn("_first", F.when(F.lag(at).over(own) >= F.col(at) - 1, 0).otherwise(1)).withColumn("_run", F.sum("_first").over(own))
    return marked.groupBy(*line, "_run", "h", "w").agg(F.min(at).alias("a"), F.max(at).alias("b")), line


def _axes(mask: DataFrame, ext: DataFrame, ends) -> DataFrame:
    """The mask after each of its runs, along the rows and then the columns, has got the ends that ``ends`` tells from a run, its line and the image's size there."""
    px = inside(mask.select(*PX).join(ext, "fov"))
    for at, size in (("c", "w"), ("r", "h")):
        found, line = _along(px, at)
        low, high = ends(Window.partitionBy(*line).orderBy("a"), F.col(size))
        moved = found.select(*line, "h", "w", low.alias("low"), high.alias("high")).where(F.col("low") <= F.col("high"))
        px = moved.select(*line, "h", "w", F.explode(F.sequence("low", "high")).alias(at))
    return px.select(*PX)


def dilate(mask: DataFrame, ext: DataFrame, k: int) -> DataFrame:
    """k x k ones, anchor k // 2; one axis after the other. A run begins where the one before it has ended, so a pixel is made once."""
    low, high = -(k - 1 - k // 2), k // 2
    return _axes(mask, ext, lambda line, size: (F.greatest(F.col("a") + low, F.lag("b").over(line) + (high + 1), F.lit(0)), F.least(F.col("b") + high, size - 1)))


def erode(mask: DataFrame, ext: DataFrame, k: int) -> DataFrame:
    """What is outside the image does not count. A pixel stays if its window along the row, and then along the column, is full."""
    low, high = -(k - 1 - k // 2), k // 2
    return _axes(mask, ext, lambda _, size: (F.when(F.col("a") == 0, 0).otherwise(F.col("a") + high), F.when(F.col("b") == size - 1, F.col("b")).otherwise(F.col("b") + low)))


def morphology(mask: DataFrame, ext: DataFrame, operation: str, k: int) -> DataFrame:
    """open, close, erode or dilate; any other name leaves the mask as it is, with a warning."""
    steps = {"open": (erode, dilate), "close": (dilate, erode), "erode": (erode,), "dilate": (dilate,)}.get(operation)
    if steps is None:
        logging.getLogger(__name__).warning("unknown morphology %r, mask unchanged", operation)
        return mask
    for step in steps:
        mask = step(mask, ext, k)
    return mask


def component_roots(r: np.ndarray, c: np.ndarray, eight: bool = True) -> np.ndarray:
    """For each pixel of an image in memory the index of the first pixel, in raster order, of its component."""
    order = np.lexsort((c, r))
    rr, cc = r[order].astype(np.int64), c[order].astype(np.int64)
    start = np.flatnonzero(np.r_[True, (rr[1:] != rr[:-1]) | (cc[1:] != cc[:-1] + 1)]) if len(rr) else np.zeros(0, dtype=np.int64)
    stop = np.r_[start[1:], len(rr)].astype(np.int64)[: len(start)]
    top = least_roots(len(start), *touching(rr[start], cc[start], cc[stop - 1], None, eight))
    out = np.empty(len(r), dtype=np.int64)
    out[order] = order[np.repeat(start[top], stop - start)]
    return out


def label(mask: DataFrame, eight: bool = True, value: str | None = None) -> DataFrame:
    """(fov, r, c, label): components numbered from 1 in raster order, by fov. Given a column of values, pixels are joined to equal ones only and value is kept."""
    rows = mask.select(*PX) if value is None else mask.select(*PX, F.col(value).alias("value"))
    return pixels(label_runs(runs(rows), eight))


def labelled_area_filter(labelled: DataFrame, least: int) -> DataFrame:
    """Labels of at least so many pixels, ids kept; 0 is background."""
    rows = labelled.where(F.col("label") != 0)
    kept = rows.groupBy("fov", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("fov", "label")
    return rows.join(shuffled(kept), ["fov", "label"], "left_semi")


def area_filter(mask: DataFrame, least: int) -> DataFrame:
    """Pixels of components of at least so many pixels."""
    return pixels(label_runs(runs(mask.select(*PX))).where(F.col("area") >= least)).select(*PX)


def holes(mask: DataFrame, ext: DataFrame) -> DataFrame:
    """(fov, r, c, label): background that is not joined, over edges of pixels, to the frame around the image. The frame's component is the first."""
    return pixels(label_runs(gaps(mask, ext), eight=False).where(F.col("label") > 1)).select(*PX, (F.col("label") - 1).alias("label"))


def fill_holes(mask: DataFrame, ext: DataFrame) -> DataFrame:
    return mask.select(*PX).union(holes(mask, ext).select(*PX))


def object_mask(filled: DataFrame, *exclude: DataFrame, least: int | None = None) -> DataFrame:
    """Filled contours without the masks to exclude, and without components of under ``least`` pixels."""
    out = subtract(filled, *exclude) if exclude else filled.select(*PX).distinct()
    return out if least is None else area_filter(out, least)


def of_label(labelled: DataFrame, value: int) -> DataFrame:
    """The mask of one label, or of one cluster of a cluster image."""
    return labelled.where(F.col("label") == value).select(*PX)


def padded(mask: DataFrame, ext: DataFrame, h: int, w: int, larger: str = "refused") -> tuple[DataFrame, DataFrame]:
    """The mask in the middle of images of h x w, and their extents; a spare row or column goes below or right.

    Larger images are refused when they are read, or, if ``larger`` is "centred", moved to the same middle with all their pixels, some of which then lie outside h x w.
    """
    if larger not in ("refused", "centred"):
        raise ValueError(f"unknown way with larger images {larger!r}")
    # half of what is spare, cut towards 0 where it is less than nothing
    half = lambda spare: (spare / 2).cast("int")
    top = half(h - F.col("h"))
    if larger == "refused":
        fits = F.when((F.col("h") > h) | (F.col("w") > w), F.raise_error(F.lit(f"an image is larger than {h} x {w}")))
        top = F.coalesce(fits.cast("int"), top)
    moved = mask.join(ext, "fov").select("fov", (F.col("r") + top).alias("r"), (F.col("c") + half(w - F.col("w"))).alias("c"))
    return moved, ext.select("fov", F.lit(h).alias("h"), F.lit(w).alias("w"))
