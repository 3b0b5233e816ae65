"""Pixels that a mask leaves out are made from what lies between its pixels: the grid of all pixels is not dealt."""

from pyspark.sql import functions as F

from densigrid.operators import masks, raster


def rows(df):
    return sorted(tuple(r) for r in df.select("fov", "r", "c").collect())


def test_complement_equals_the_grid_without_the_mask(spark):
    ext = spark.createDataFrame([("A", 3, 5), ("B", 2, 1), ("C", 2, 4)], "fov string, h int, w int")
    px = [("A", 0, 0), ("A", 0, 4), ("A", 1, 2), ("A", 1, 2), ("A", 1, 7), ("A", 1, -3), ("A", 5, 1), ("A", 5, 4), ("B", 0, 0), ("A", 2, None), ("D", 0, 3)]
    got = masks.complement(spark.createDataFrame(px, "fov string, r int, c int"), ext)
    assert rows(got) == [(f, r, c) for f, h, w in (("A", 3, 5), ("B", 2, 1), ("C", 2, 4)) for r in range(h) for c in range(w) if (f, r, c) not in px]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan  # neither the grid nor the mask is joined


def test_low_pixels_with_and_without_a_row(spark):
    ext = spark.createDataFrame([("A", 2, 3)], "fov string, h int, w int")
    dense = spark.createDataFrame([("A", 0, 0, 5), ("A", 0, 1, 1), ("A", 1, 2, -4), ("A", 1, 0, None), ("A", 0, 9, -9)], "fov string, r int, c int, v int")
    value = {(0, 0): 5, (0, 1): 1, (1, 2): -4}
    for limit in (-3, 0, 0.5, 1, 2, 6):
        want = [("A", r, c) for r in range(2) for c in range(3) if value.get((r, c), 0) < limit]
        assert rows(raster.threshold(dense, ext, limit, "lower")) == want
    assert raster.threshold(dense, ext, 2, "lower").where(F.col("c") > 2).count() == 0
