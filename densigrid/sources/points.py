"""Point sources: tables and files of labelled points, one row a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.functions.columns import natural_key

CONTROL_PATTERN = "System|egative"  # names of negative-control targets


def cohort_files(spark: SparkSession, folder: str, suffix: str = "", exclude: tuple = ()) -> DataFrame:
    """(path, name, fov) of a cohort's files whose names end so, without those excluded, in natural order. Contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    out = rows.select("path", name.alias("name"), F.regexp_extract("path", "FOV\\d+", 0).alias("fov")).where(~F.col("name").isin(*exclude) if exclude else F.lit(True))
    return out.orderBy(natural_key(F.col("name")), "path")


def read_points_csv(spark: SparkSession, path: str | list[str], x: str = "x", y: str = "y", target: str = "target", skip: tuple = (), suffix: str = "") -> DataFrame:
    """(fov, x, y, target): one scan over all CSV files of a cohort (a folder, a glob or a list) whose names end with ``suffix``.

    Columns go by the header; places are doubles. fov is taken from the path (FOV and digits), and fovs in ``skip`` are left out.
    """
    rows = spark.read.option("header", True).option("pathGlobFilter", f"*{suffix}").csv(path)
    fov = F.regexp_extract(F.col("_metadata.file_path"), "FOV\\d+", 0)
    out = rows.select(fov.alias("fov"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(target).alias("target"))
    return out.where(~F.col("fov").isin(*skip)) if skip else out


def clean(points: DataFrame) -> DataFrame:
    """Without negative controls, moved to the origin of each fov, coordinates rounded half to even."""
    kept = points.where(~F.col("target").rlike(CONTROL_PATTERN))
    least = kept.groupBy("fov").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))  # one row a fov
    moved = kept.join(least, "fov")
    return moved.select("fov", F.rint(F.col("x") - F.col("x0")).cast("int").alias("r"), F.rint(F.col("y") - F.col("y0")).cast("int").alias("c"), "target")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fov, r, c, target, event_id) from the events table: value is the row, user the column, ten days a fov."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    fov = F.concat(F.lit("F"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string"))
    return e.select(fov.alias("fov"), F.floor("value").cast("int").alias("r"), F.col("user_id").cast("int").alias("c"), F.col("event_type").alias("target"), "event_id")
