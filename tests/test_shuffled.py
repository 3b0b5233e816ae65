"""Sides of joins that are small as files, and large once they are spread over pixels, stay out of the driver."""

import pytest

from densigrid.operators import contours, masks, neighbors


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('points')}/points.parquet"
    rows = [("F", i, 2 * (i % 5), 2 * (i // 5)) for i in range(60)]
    spark.createDataFrame(rows, "fov string, id long, r int, c int").write.parquet(path)
    return spark.read.parquet(path)


def broadcasts(df):
    """How many sides of joins are broadcast in the plan, before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_sites_near_sites_are_dealt_by_tile(points):
    assert broadcasts(neighbors.neighbor_count(points, 3)) == 0
    assert broadcasts(neighbors.dbscan(points, 3, 3)) == 0
    assert neighbors.dbscan(points, 3, 3).where("cluster = 0").count() == 60


def test_filled_rings_meet_their_signal_by_pixel(spark, points, tmp_path):
    spark.createDataFrame([("F", 1, [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)])], f"fov string, ring_id int, ring {contours.RING}").write.parquet(f"{tmp_path}/rings")
    rings = spark.read.parquet(f"{tmp_path}/rings")
    signal = points.selectExpr("fov", "r", "c", "1L AS v")
    assert broadcasts(contours.nonempty(rings, signal, "fov", "ring_id")) == 0
    assert contours.nonempty(rings, signal, "fov", "ring_id").count() == 1


def test_masks_meet_by_pixel(points):
    assert broadcasts(masks.subtract(points, points.where("id > 3"))) == 0
    assert broadcasts(masks.intersect(points, points.where("id > 3"))) == 0
