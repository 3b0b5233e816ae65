"""Components over strips, holes, hulls, chains of operators, statistics and files, against brute force and exact values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from densigrid.functions.columns import natural_key
from densigrid.functions.statistics import beta_share, t_two_sided
from densigrid.operators import bins, contours, expand, features, hulls, inpaint, masks, neighbors, raster, runs
from densigrid.sources import points as source
from densigrid.sources import sinks


def px(spark, img, label=None):
    rows = [("F", int(r), int(c)) + ((int(img[r, c]),) if label else ()) for r, c in np.argwhere(img)]
    return spark.createDataFrame(rows, "fov string, r int, c int" + (f", {label} int" if label else ""))


def ext(spark, h, w):
    return spark.createDataFrame([("F", h, w)], "fov string, h int, w int")


def got(df):
    return {(x["r"], x["c"]) for x in df.collect()}


def flood(img, eight, same=lambda a, b: a == b):
    """{pixel: first pixel of its component} of the nonzero pixels, equal values only."""
    of = {}
    for p in map(tuple, np.argwhere(img)):
        todo = [] if p in of else [p]
        while todo:
            q = todo.pop()
            if q not in of:
                of[q] = p
                around = [(q[0] + y, q[1] + x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (eight or y * x == 0)]
                todo += [n for n in around if 0 <= n[0] < img.shape[0] and 0 <= n[1] < img.shape[1] and img[n] and same(img[n], img[q])]
    return of


@pytest.mark.parametrize(("strip", "eight"), [(3, True), (3, False), (512, True)])
def test_components_across_strips(spark, monkeypatch, strip, eight):
    monkeypatch.setattr(runs, "STRIP", strip)
    rng = np.random.default_rng(strip)
    img = (rng.random((17, 14)) < 0.55) * rng.integers(1, 3, (17, 14))
    for value in (None, "value"):
        of = flood(img if value else (img > 0).astype(int), eight)
        number = {p: i for i, p in enumerate(sorted(set(of.values())), 1)}
        rows = masks.label(px(spark, img, "value"), eight, value).collect()
        assert {(x["r"], x["c"]): x["label"] for x in rows} == {p: number[q] for p, q in of.items()}
    whole = flood((img > 0).astype(int), True)
    sizes = {q: sum(v == q for v in whole.values()) for q in set(whole.values())}
    assert got(masks.area_filter(px(spark, img), 6)) == {p for p, q in whole.items() if sizes[q] >= 6}


def test_holes_across_strips(spark, monkeypatch):
    monkeypatch.setattr(runs, "STRIP", 4)
    img = (np.random.default_rng(8).random((15, 12)) < 0.6).astype(int)
    back = np.pad(1 - img, 1, constant_values=1)
    of = flood(back, False)
    inner = {(r - 1, c - 1) for (r, c), q in of.items() if q != (0, 0)}
    assert got(masks.holes(px(spark, img), ext(spark, 15, 12))) == inner
    assert got(masks.fill_holes(px(spark, img), ext(spark, 15, 12))) == inner | set(map(tuple, np.argwhere(img)))


@pytest.mark.parametrize("k", [2, 3, 4])
def test_erosion_leaves_the_outside_out(spark, k):
    img = (np.random.default_rng(k).random((9, 11)) < 0.85).astype(int)
    low, high = -(k - 1 - k // 2), k // 2
    full = {(r, c) for r in range(9) for c in range(11) if all(img[r - y, c - x] for y in range(low, high + 1) for x in range(low, high + 1) if 0 <= r - y < 9 and 0 <= c - x < 11)}
    assert got(masks.erode(px(spark, img), ext(spark, 9, 11), k)) == full


def test_object_mask_padding_and_labels(spark):
    img = np.zeros((10, 10), dtype=int)
    img[1:5, 1:5], img[7, 7] = 1, 2
    hole = np.zeros((10, 10), dtype=int)
    hole[1, 1] = 1
    assert len(got(masks.object_mask(px(spark, img), px(spark, hole), least=5))) == 15
    assert got(masks.of_label(px(spark, img, "label"), 2)) == {(7, 7)}
    moved, size = masks.padded(px(spark, hole), ext(spark, 10, 10), 13, 14)
    assert got(moved) == {(2, 3)} and size.first()[1:] == (13, 14)
    with pytest.raises(Exception, match="larger"):
        masks.padded(px(spark, hole), ext(spark, 10, 10), 5, 14)[0].collect()


def test_nearest_sources_by_object(spark):
    rng = np.random.default_rng(1)
    img = (rng.random((13, 16)) < 0.06) * rng.integers(1, 3, (13, 16))
    rows = expand.nearest_within(px(spark, img, "label").withColumn("key", F.col("label")), ext(spark, 13, 16), 4, "key").collect()
    want = {}
    for key in (1, 2):
        own = [tuple(p) for p in np.argwhere(img == key)]
        for p in itertools.product(range(13), range(16)):
            best = min(((p[0] - y) ** 2 + (p[1] - x) ** 2, y, x) for y, x in own)
            if 0 < best[0] <= 16:
                want[key, *p] = best
    assert {(x["key"], x["r"], x["c"]): (x["d2"], x["sr"], x["sc"]) for x in rows} == want


def test_propagation_over_three_rings_and_empty_seeds(spark):
    img = np.zeros((30, 30), dtype=int)
    img[5:10, 5:10], img[20:25, 20:25] = 1, 2
    seed = px(spark, img, "label")
    rows = expand.propagate(seed, ext(spark, 30, 30), [2, 4, 6]).collect()
    assert len(rows) == expand.rings(seed, ext(spark, 30, 30), [6]).count() and {x["label"] for x in rows} == {1, 2}
    assert expand.rings(seed.limit(0), ext(spark, 30, 30), [3]).count() == 0
    with pytest.raises(ValueError):
        expand.constrained(None, ext(spark, 3, 3))
    labelled, whole = expand.constrained(seed, ext(spark, 30, 30))
    assert labelled.select("label").distinct().count() == 2 and whole.count() == 900


def test_class_growth_without_enough_seeds(spark):
    own = spark.createDataFrame([("F", 5, 5, 1, "A"), ("F", 5, 9, 2, "B")], "fov string, r int, c int, parent int, class string")
    square = lambda x, y: [(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2), (x, y)]
    rings = spark.createDataFrame([("F", "B", 1, square(8, 4)), ("F", "A", 2, square(4, 4))], f"fov string, class string, contour int, ring {contours.RING}")
    seeds = expand.seeds_of(rings, ["A", "B"])
    assert [tuple(r) for r in seeds.orderBy("idx").collect()] == [("F", 0, "A", 5.0, 5.0), ("F", 1, "B", 9.0, 5.0)]
    free = expand.class_limited_rings(own, ext(spark, 11, 15), seeds, [3, 2])
    assert free.where("ring = 2").count() == 0 and free.where("class = 'A' and r = 5 and c = 8").first()["referenced"] == 2
    more = seeds.union(seeds.withColumn("idx", F.col("idx") + 2))
    held = expand.class_limited_rings(own, ext(spark, 11, 15), more, [3])
    assert held.where("class = 'A' and c > 7").count() == 0 and held.where("class = 'A' and r = 5 and c = 7").count() == 1
    with pytest.raises(ValueError):
        expand.seeds_of(rings.limit(0), ["A"])


def test_contour_chain_drops_small_and_empty_rings(spark):
    img = np.zeros((40, 40), dtype=int)
    img[2:12, 2:12], img[20:30, 20:30], img[35:37, 35:37], img[25, 25] = 1, 1, 1, 0
    signal = spark.createDataFrame([("F", 3, 3, 1), ("F", 25, 26, 2)], "fov string, r int, c int, v int")
    found = contours.region_contours(px(spark, img), signal, 2)
    assert sorted((r["hole"], r["area"]) for r in found.select("hole", contours.ring_area(F.col("ring")).alias("area")).collect()) == [(False, 81.0), (False, 81.0), (True, 2.0)]
    assert contours.region_contours(px(spark, img), signal.limit(1), 2).count() == 1
    block = px(spark, img).selectExpr("*", "1L AS v")
    assert contours.contours_from_sum(block, ext(spark, 40, 40), 5, 12, 30).count() == 2
    with pytest.raises(ValueError):
        contours.contours_from_sum(block, ext(spark, 40, 40), 5, 12, 30, "sideways")


def test_polygons_are_simple(spark):
    rings = [
        [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], [(0, 0), (4, 0), (8, 0), (0, 0)], [(0, 0), (1, 1), (0, 1)],
        [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)], [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6), (0, 0)], [(0, 0), (4, 0), (2, 0), (2, 3), (0, 0)],
    ]
    rows = spark.createDataFrame([("F", i, r) for i, r in enumerate(rings)], f"fov string, label int, ring {contours.RING}")
    kept = contours.polygons(rows).collect()
    assert [(x["label"], x["ring"][0] == x["ring"][-1]) for x in sorted(kept, key=lambda x: x["label"])] == [(0, True), (5, True)]


def alpha_area(points, radius):
    """Twice the area of all triangles with an empty circle under the radius, over distinct circles; points in general position."""
    total = 0
    for t in itertools.combinations(range(len(points)), 3):
        a, b, c = (points[i].astype(float) for i in t)
        d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        if d:
            x, y, r2 = hulls.circles(a[None], b[None], c[None])
            at = a + (x[0], y[0])
            if r2[0] < radius**2 and not (((points - at) ** 2).sum(1) < r2[0] - 1e-9).any():
                total += abs(d) / 2
    return total


def test_concave_hulls_against_all_triangles():
    for seed in range(6):
        pts = np.unique(np.random.default_rng(seed).integers(0, 400, (25, 2)), axis=0)  # wide apart: no four on a circle
        for radius in (60, 120, 1000):
            kept = hulls.triangles(pts, radius)
            e = pts[kept]
            area = ((e[:, 1, 0] - e[:, 0, 0]) * (e[:, 2, 1] - e[:, 0, 1]) - (e[:, 1, 1] - e[:, 0, 1]) * (e[:, 2, 0] - e[:, 0, 0])).sum()
            assert area == alpha_area(pts, radius)
    grid = np.array(list(itertools.product(range(6), range(5))))
    corner = grid[~((grid[:, 0] > 2) & (grid[:, 1] > 2))]  # an L
    ring = np.array([*(r := hulls.concave(corner, 1.0)), r[0]])
    assert abs((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum()) / 2 == 20 - 4 - 2 + 0.5
    assert hulls.concave(np.concatenate([grid, grid + 100]), 1.0) == [] and hulls.concave(grid[:2], 1.0) == [] and hulls.concave(corner, 100) == []


def test_contours_around_clusters(spark):
    pts = [(i, r, c) for i, (r, c) in enumerate([*itertools.product(range(10, 20), range(10, 20)), (40, 40), (60, 1), (61, 1), (62, 2), (62, 2)])]
    rows = spark.createDataFrame([("F", *p) for p in pts], "fov string, id long, r int, c int")
    clustered, size = neighbors.dbscan(rows, 2, 3).cache(), ext(spark, 70, 70)
    area = lambda kind, **more: {x["cluster"]: x["a"] for x in neighbors.cluster_contours(clustered, size, kind, 2, **more).select("cluster", contours.ring_area(F.col("ring")).alias("a")).collect()}
    assert area("complex_hull") == {0: 81.0, 1: 0.5} and area("concave_hull", alpha=1.0)[0] == 81.0 and area("concave_hull", alpha=0.0)[0] == 81.0
    circle = area("simple_circle")
    disc = {(y, x) for y in range(-6, 7) for x in range(-6, 7) if y * y + x * x <= 36}  # the centre is cut to (14, 14), the radius to 6
    corners = [sum((y + a, x + b) in disc for a in (0, 1) for b in (0, 1)) for y in range(-7, 7) for x in range(-7, 7)]
    assert circle[0] == corners.count(4) + corners.count(3) / 2 and len(circle) == 2
    with pytest.raises(ValueError):
        neighbors.cluster_contours(clustered, size, "star", 2)
    found = neighbors.contours_from_neighbors(rows, size, 2, 7, 5)
    assert found.count() == 1
    whole = inpaint.inpainted(neighbors.neighbor_raster(rows, 2), size)
    assert neighbors.contours_from_neighbors(rows, size, 2, 7, 5, raster=whole).count() >= 1


def test_inpainting_fills_between_known_values(spark):
    rows = spark.createDataFrame([("F", 2, 2, 4.0), ("F", 2, 12, 4.0), ("F", 9, 5, 8.0)], "fov string, r int, c int, v double")
    v = {(x["r"], x["c"]): x["v"] for x in inpaint.inpainted(rows, ext(spark, 12, 15)).collect()}
    assert len(v) == 180 and all(4.0 <= x <= 8.0 for x in v.values()) and (v[2, 2], v[9, 5]) == (4.0, 8.0) and v[9, 6] > v[1, 2]
    assert inpaint.inpainted(rows.limit(0), ext(spark, 3, 3)).count() == 0


def test_analysis_of_definitions(spark):
    img = np.zeros((20, 20), dtype=int)
    img[2:6, 2:6], img[10:13, 10:13] = 1, 1
    pres = spark.createDataFrame([("F", 2, 2, "a"), ("F", 11, 11, "a"), ("F", 11, 11, "b"), ("F", 19, 19, "a")], "fov string, r int, c int, target string")
    size, whole = ext(spark, 20, 20), px(spark, img)
    make = features.MaskDefinition
    rows = features.analysed([make(whole, "m", "bulk"), make(whole, "m", "per_object"), make(whole, "m", "grid", 5), make(whole.limit(0), "none", "bulk")], pres, ["a", "b"], size)
    out = {(x["mask_name"], x["analysis_type"], x["object_id"], x["grid_y"], x["grid_x"]): (x["area"], x["a"], x["b"], x["solidity"]) for x in rows.collect()}
    assert out["m", "bulk", "bulk", None, None] == (25, 2, 1, None) and out["none", "bulk", "bulk", None, None] == (0, 0, 0, None)
    assert out["m", "per_object", "1", None, None] == (16, 1, 0, 1.0) and out["m", "per_object", "2", None, None] == (9, 1, 1, 1.0)
    assert {k[3:]: v[:3] for k, v in out.items() if k[1] == "grid"} == {(0, 0): (9, 1, 0), (0, 5): (3, 0, 0), (5, 0): (3, 0, 0), (5, 5): (1, 0, 0), (10, 10): (9, 1, 1)}
    for bad in (make(whole, "m", "grid"), make(whole, "m", "slice")):
        with pytest.raises(ValueError):
            features.analysed([bad], pres, ["a"], size)
    parent = px(spark, np.where(np.arange(20)[:, None] < 11, img * 7, img * 9), "label")
    table = features.hierarchies({"m": (whole, parent, "p")})
    joined = features.with_parents(rows, table, ["m"])
    assert {(x["analysis_type"], x["object_id"]): x["parent_ids"] for x in joined.where("mask_name = 'm'").collect()} == {("bulk", "bulk"): None, ("per_object", "1"): [7], ("per_object", "2"): [7, 9], ("grid", "1"): [7], ("grid", "2"): [7, 9]}


def test_merge_and_checks(spark):
    left = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, name string, n int")
    right = spark.createDataFrame([(1, 7, 0), (1, 8, 1), (3, 9, 2)], "id int, n int, at int")
    assert {tuple(r) for r in features.merged(left, right, ["id"], "at").select("id", "name", "n").collect()} == {(1, "x", 8), (2, "y", 6)}
    assert features.merged(left.limit(0), right, ["id"]).count() == 3 and features.merged(left, right.limit(0), ["id"]).count() == 2
    assert [tuple(r) for r in features.negative_counts(spark.createDataFrame([(1, -2, 3)], "id int, a int, b int"), ["a", "b"]).collect()] == [(1, "a", -2)]


def test_tail_probabilities(spark):
    import pandas as pd

    for t, df in ((0.0, 4.0), (1.3, 3.0), (-2.5, 11.7), (4.0, 250.0)):
        x = np.linspace(abs(t), abs(t) + 400, 4_000_001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert math.isclose(t_two_sided(pd.Series([t]), pd.Series([df]))[0], 2 * np.trapezoid(density, x), rel_tol=1e-4)
    assert np.allclose(beta_share(np.array([0.0, 0.3, 1.0]), np.array([2.0, 2.0, 2.0]), 1.0), [0, 0.09, 1])
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(i % 2), float(rng.normal(i % 2)), float(rng.normal())) for i in range(200)], "g int, a double, b double")
    found = {(r["grp"], r["target"]): r for r in bins.markers(rows, "g", ["a", "b"], 2).collect()}
    assert found[1, "a"]["pval"] < 1e-6 and math.isclose(found[1, "a"]["pval_adj"], 2 * found[1, "a"]["pval"]) and math.isclose(found[1, "b"]["pval"], found[1, "b"]["pval_adj"])


def test_bin_statistics(spark):
    pts = spark.createDataFrame([("F", 5, 5, "a", 2), ("F", 9, 1, "a", 1), ("F", 15, 5, "b", 3)], "fov string, r int, c int, target string, id int")
    rows = {(x["bx"], x["by"]): (x["x_centroid"], x["x_coord"], x["y_coord"]) for x in bins.bin_counts(pts, 10, ["a", "b"], "id").collect()}
    assert rows == {(0, 0): (70.0, 90, 10), (1, 0): (150.0, 150, 50)}
    joined = bins.cohort({"s": bins.bin_counts(pts, 10, ["a"]), "t": bins.bin_counts(pts, 10, ["b"])}, "k", ["a", "b"])
    assert {(r["name"], r["bx"]): (r["a"], r["b"]) for r in joined.collect()} == {("s", 0): (2, 0), ("s", 1): (0, 0), ("t", 0): (0, 0), ("t", 1): (0, 1)}
    img = bins.cluster_image(spark.createDataFrame([("F", 1, 2, 0), ("F", 0, 0, 1)], "fov string, bx long, by long, cluster int"), 3)
    assert {(x["r"], x["c"]): x["label"] for x in img.collect()} == {**{(r, c): 1 for r in (3, 4, 5) for c in (6, 7, 8)}, **{(r, c): 2 for r in range(3) for c in range(3)}}
    v = spark.createDataFrame([("g", float(x), 3.0) for x in (1, 2, 3, 10)], "grp string, v double, w double")
    assert tuple(bins.quartiles(v, "grp", "v").first()) == ("g", 4, 1.0, 1.75, 2.5, 4.75, 10.0)
    z = bins.scaled(v, ["v", "w"], 1.0).orderBy("v").collect()
    assert z[-1]["v"] == 1.0 and math.isclose(z[0]["v"], -3 / np.std([1, 2, 3, 10], ddof=1)) and z[0]["w"] == 0.0
    assert bins.elbow([50, 30, 12, 4, 4]) == 4 and bins.elbow([]) == 0 and bins.elbow([1.0]) == 1


def test_nearest_bins_in_wide_buckets(spark):
    at = np.random.default_rng(3).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(at)], "id long, e array<double>")
    d = np.sqrt(((at[:, None] - at) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    found = {}
    for x in bins.nearest_bins(rows, "id", "e", 3, 100.0, 50.0).collect():
        found.setdefault(x["id"], []).append((x["rank"], x["neighbor"]))
    assert {i: [n for _, n in sorted(v)] for i, v in found.items()} == {i: np.argsort(d[i])[:3].tolist() for i in range(60)}


def test_map_training_draws_from_all_rows(spark):
    rows = spark.range(3000).select("id", F.array(F.when(F.col("id") < 1500, 0.0).otherwise(8.0) + F.rand(1)).alias("e"))
    units = sorted(u[0] for u in bins.som_units(rows, "id", "e", (2, 1), steps=800))
    assert 0 <= units[0] < 1.5 and 7.5 < units[1] <= 9


def test_csv_cohort(spark, tmp_path):
    head = "gene,X,extra,Y\n"
    for name, body in (("s10_FOV10_call.csv", "a,1.5,q,2.5\nSystemX,0,q,0\n"), ("s2_FOV2_call.csv", "b,3,q,4\nb,5.5,q,4.5\n"), ("s3_FOV3_call.csv", "c,7,q,8\n"), ("s2_FOV2_other.csv", "z,0,q,0\n")):
        (tmp_path / name).write_text(head + body)
    files = source.cohort_files(spark, str(tmp_path), "_call.csv", ("s3_FOV3_call.csv",)).collect()
    assert [(x["name"], x["fov"]) for x in files] == [("s2_FOV2_call.csv", "FOV2"), ("s10_FOV10_call.csv", "FOV10")]
    rows = source.read_points_csv(spark, [x["path"] for x in files], "X", "Y", "gene")
    assert {tuple(r) for r in source.clean(rows).collect()} == {("FOV10", 0, 0, "a"), ("FOV2", 0, 0, "b"), ("FOV2", 2, 0, "b")}
    whole = source.read_points_csv(spark, str(tmp_path), "X", "Y", "gene", skip=("FOV10",), suffix="_call.csv")
    assert {r["target"] for r in whole.collect()} == {"b", "c"}
    sinks.write_csv(rows.groupBy("fov").count(), str(tmp_path / "out"))
    done = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sinks.not_done(whole, done).select("fov").distinct().collect()[0]["fov"] == "FOV3"
    names = spark.createDataFrame([("a10b2",), ("a2b10",), ("a2b9",), ("b",)], "n string")
    assert [r["n"] for r in names.orderBy(natural_key(F.col("n"))).collect()] == ["a2b9", "a2b10", "a10b2", "b"]


def test_reraster_counts_channels_as_they_appear(spark):
    pts = spark.createDataFrame([("F", 1, 1, "c", 5), ("F", 1, 1, "a", 9), ("F", 2, 2, "c", 6), ("F", 0, 0, "z", 1)], "fov string, r int, c int, target string, id int")
    assert {(x["target"], x["channel"]) for x in raster.reraster(pts, ["a", "c", "none"], "id").collect()} == {("c", 0), ("a", 1)}
    assert {(x["r"], x["v"]) for x in raster.target_sum(pts, ["a", "c"]).collect()} == {(1, 2), (2, 1)}
