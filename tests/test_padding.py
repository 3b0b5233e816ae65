"""Padding of images that are larger than what they are padded to."""

import duckdb
import pytest

from densigrid.operators import masks


def test_larger_images_keep_all_pixels_and_their_middle(spark):
    mask = spark.createDataFrame([("F", 0, 0), ("F", 10, 20), ("F", 4, 1)], "fov string, r int, c int")
    ext = spark.createDataFrame([("F", 11, 21)], "fov string, h int, w int")
    moved, size = masks.padded(mask, ext, 6, 40, "centred")
    want = duckdb.sql("SELECT r + (6 - 11) // 2, c + (40 - 21) // 2 FROM (VALUES (0, 0), (10, 20), (4, 1)) p(r, c)").fetchall()
    assert sorted((p["r"], p["c"]) for p in moved.collect()) == sorted(want)
    assert [tuple(x) for x in size.collect()] == [("F", 6, 40)]
    with pytest.raises(ValueError):
        masks.padded(mask, ext, 6, 40, "cut")
