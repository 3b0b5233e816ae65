"""Rings with sides as long as a field of many users: products of two lengths exceed 32 bits."""

from densigrid.operators import contours, neighbors


def test_a_ring_with_sides_over_46340_pixels_is_filled(spark):
    wide = 90_000
    rings = spark.createDataFrame([("F", [(0, 0), (0, 2), (wide, 2), (wide, 0), (0, 0)])], f"fov string, ring {contours.RING}")
    got = contours.fill(rings, "fov").selectExpr("count(*)", "count(distinct r, c)", "min(c)", "max(c)", "sum(r)").first()
    assert tuple(got) == (3 * (wide + 1), 3 * (wide + 1), 0, wide, 3 * (wide + 1))


def test_a_steep_side_across_a_large_field_is_filled(spark):
    far = 50_000
    rings = spark.createDataFrame([("F", [(0, 0), (far, far), (far, far - 1), (0, 0)])], f"fov string, ring {contours.RING}")
    assert contours.fill(rings, "fov").where(f"r = {far // 2}").selectExpr("min(c)", "max(c)").first()[:] == (far // 2, far // 2 + 1)


def test_a_disc_with_a_radius_over_46340_is_cut_into_runs(spark):
    circles = spark.createDataFrame([("F", 0, 1.0, 60_000.0, 50_000.0)], "fov string, cluster int, cy double, cx double, radius double")
    ext = spark.createDataFrame([("F", 3, 120_000)], "fov string, h int, w int")
    got = neighbors.circle_runs(circles, ext).orderBy("r").select("r", "c0", "c1").collect()
    assert [tuple(x) for x in got] == [(0, 10_001, 109_999), (1, 10_000, 110_000), (2, 10_001, 109_999)]
