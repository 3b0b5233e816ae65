"""Cell segmentations: outlines in JSON, or label masks, as pixels (fov, r, c, cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.operators.contours import checked, fill, shifted

GEOMETRIES = "geometries array<struct<cell:string,coordinates:array<array<array<double>>>>>"


def read_outlines(spark: SparkSession, path: str, fov: str = "F") -> DataFrame:
    """(fov, cell, ring) from JSON documents that list cells with coordinates (x, y); the first ring of each is its outline."""
    rows = spark.read.schema(GEOMETRIES).option("multiLine", True).json(path).select(F.explode("geometries").alias("g"))
    ring = F.transform(F.element_at("g.coordinates", 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(F.lit(fov).alias("fov"), F.col("g.cell").cast("int").alias("cell"), ring.alias("ring"))


def cell_pixels(segmentation: DataFrame, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """(fov, r, c, cell) of outlines (a column ring; moved to the origin x, y) or of a label mask (a column label; 0 is background)."""
    if "ring" in segmentation.columns:
        return fill(checked(shifted(segmentation, x, y)), "fov", "cell").select("fov", "r", "c", "cell")
    if "label" in segmentation.columns:
        return segmentation.where(F.col("label") != 0).select("fov", "r", "c", F.col("label").alias("cell"))
    raise ValueError("a segmentation has a column ring or label")
