"""Small fixtures with exact values, and brute force for the kernels."""

import numpy as np
import pytest

from densigrid.operators import bins, expand, features, masks, neighbors, raster


def px(spark, pixels, fov="F"):
    return spark.createDataFrame([(fov, int(r), int(c)) for r, c in pixels], "fov string, r int, c int")


def ext(spark, h, w):
    return spark.createDataFrame([("F", h, w)], "fov string, h int, w int")


def square(r0, r1, c0, c1):
    return [(r, c) for r in range(r0, r1) for c in range(c0, c1)]


def got(df):
    return {(x["r"], x["c"]) for x in df.collect()}


def test_box_sum_of_two_blocks(spark):
    rows = px(spark, square(30, 40, 30, 40) + square(60, 70, 60, 70)).selectExpr("*", "1L AS v")
    v = {(x["r"], x["c"]): x["v"] for x in raster.density(rows, ext(spark, 100, 100), 5).collect()}
    assert (v[35, 35], v.get((27, 35), 0), v[28, 35], v[28, 28], sum(v.values())) == (25, 0, 5, 1, 5000)


@pytest.mark.parametrize("k", [4, 5, 10])
def test_box_sum_reflects_borders(spark, k):
    rng = np.random.default_rng(k)
    a = rng.integers(0, 3, (14, 17))
    rows = spark.createDataFrame([("F", int(r), int(c), int(a[r, c])) for r, c in np.argwhere(a)], "fov string, r int, c int, v long")
    wide = np.pad(a, k, mode="reflect")
    want = {}
    for r in range(14):
        for c in range(17):
            s = wide[r + k - k // 2 : r + 2 * k - k // 2, c + k - k // 2 : c + 2 * k - k // 2].sum()
            if s:
                want[r, c] = s
    assert {(x["r"], x["c"]): x["v"] for x in raster.density(rows, ext(spark, 14, 17), k).collect()} == want


def test_unknown_names_are_refused(spark):
    rows = px(spark, [(1, 1)]).selectExpr("*", "1L AS v")
    with pytest.raises(ValueError):
        raster.density(rows, ext(spark, 5, 5), 3, "star")
    with pytest.raises(ValueError):
        raster.threshold(rows, ext(spark, 5, 5), 1, "sideways")


def test_lower_threshold_counts_empty_pixels(spark):
    rows = px(spark, [(1, 1)]).selectExpr("*", "5L AS v")
    assert len(got(raster.threshold(rows, ext(spark, 4, 5), 2, "lower"))) == 19


def test_subset_keeps_requests(spark):
    pres = spark.createDataFrame([("F", 0, 0, "a"), ("F", 1, 1, "b")], "fov string, r int, c int, target string")
    rows = raster.subset(pres, ["b", "a", "b", "none"]).collect()
    assert sorted((x["target"], x["channel"]) for x in rows) == [("a", 1), ("b", 0), ("b", 2)]


def test_set_algebra_and_subtract(spark):
    e = ext(spark, 100, 100)
    left = masks.subtract(raster.grid(e), px(spark, square(10, 20, 10, 20)), px(spark, square(15, 25, 15, 25)))
    have = got(left)
    assert len(have) == 10000 - 175 and (12, 12) not in have and (22, 22) not in have and (30, 30) in have


def test_fill_open_and_area(spark):
    e = ext(spark, 40, 40)
    ring = [p for p in square(10, 31, 10, 31) if not (15 <= p[0] <= 20 and 15 <= p[1] <= 20)]
    assert len(got(masks.fill_holes(px(spark, ring), e))) == 441
    assert len(got(masks.morphology(px(spark, square(10, 20, 10, 20) + [(5, 5)]), e, "open", 3))) == 100
    assert len(got(masks.area_filter(px(spark, square(1, 3, 1, 3) + square(5, 9, 5, 9)), 5))) == 16
    assert len(got(masks.morphology(px(spark, [(1, 1)]), e, "twist", 3))) == 1


@pytest.mark.parametrize("eight", [True, False])
def test_components_against_flood_fill(eight):
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.random((12, 15)) < 0.45
        r, c = np.nonzero(a)
        at = rng.permutation(len(r))
        roots = masks.component_roots(r[at], c[at], eight)
        seen: dict = {}
        for p in zip(*np.nonzero(a)):
            if p in seen:
                continue
            todo, seen[p] = [p], p
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        q = (y + dy, x + dx)
                        if (eight or dy * dx == 0) and 0 <= q[0] < 12 and 0 <= q[1] < 15 and a[q] and q not in seen:
                            seen[q] = p
                            todo.append(q)
        assert [(r[at][i], c[at][i]) for i in roots] == [seen[y, x] for y, x in zip(r[at], c[at])]


def test_rings_have_exact_sizes_and_keep_the_seed(spark):
    e, seed = ext(spark, 30, 30), px(spark, square(10, 15, 10, 15))
    ringed = expand.rings(seed, e, [9, 3, 6, 3]).cache()
    assert {x["ring"]: x["count"] for x in ringed.groupBy("ring").count().collect()} == {3: 76, 6: 132, 9: 188}
    left = got(expand.constraint_remaining(raster.grid(e), ringed))
    assert got(seed) <= left and len(left) == 900 - 396


def test_ring_with_constraint_and_area(spark):
    e = ext(spark, 20, 20)
    seed = px(spark, square(2, 4, 2, 4) + square(10, 14, 10, 14))
    ring = expand.rings(seed, e, [3], px(spark, square(0, 20, 8, 20)), 5)
    assert ring.count() == 60
    assert got(expand.rings(px(spark, [(4, 4)]), ext(spark, 10, 10), [1])) == {(3, 4), (5, 4), (4, 3), (4, 5)}


def test_propagation_takes_nearest_labels(spark):
    seed = px(spark, square(5, 10, 5, 10)).selectExpr("*", "1 AS label").union(px(spark, square(20, 25, 20, 25)).selectExpr("*", "2 AS label"))
    rows = expand.propagate(seed, ext(spark, 30, 30), [3, 6]).collect()
    assert sum(x["ring"] == 3 for x in rows) == 152
    assert all(x["label"] == (1 if x["r"] + x["c"] < 29 else 2) for x in rows if x["r"] + x["c"] != 29 and x["ring"] == 3)


def test_features_counts_and_hierarchy(spark):
    child, parent = px(spark, square(3, 5, 3, 5)).selectExpr("*", "1 AS label"), px(spark, square(2, 6, 2, 6)).selectExpr("*", "1 AS label")
    row = features.objects(child).first()
    assert (row["area"], row["centroid_y"], row["min_row"], row["max_col"], round(row["eccentricity"], 6)) == (4, 3.5, 3, 5, 0.0)
    assert features.hierarchy(child, parent).first()["parent_ids"] == [1]
    pres = spark.createDataFrame([("F", 3, 3, "a")], "fov string, r int, c int, target string")
    got_ = features.counts(child, pres, ["a", "b"], ["fov", "label"]).first()
    assert (got_["a"], got_["b"]) == (1, 0)


def test_overlap_keeps_zeros(spark):
    cells = px(spark, square(0, 4, 0, 4)).selectExpr("*", "1 AS cell").union(px(spark, square(6, 8, 6, 8)).selectExpr("*", "2 AS cell"))
    named = px(spark, square(0, 2, 0, 2)).selectExpr("*", "'a' AS mask").union(px(spark, square(0, 4, 0, 1)).selectExpr("*", "'b' AS mask"))
    rows = {(x["cell"], x["mask"]): (x["n"], x["percent"]) for x in features.overlap(cells, named).collect()}
    assert rows == {(1, "a"): (4, 50.0), (1, "b"): (4, 50.0), (2, "a"): (0, 0.0), (2, "b"): (0, 0.0)}


def test_neighbors_dbscan_and_hull(spark):
    rng = np.random.RandomState(0)
    x, y = rng.randint(10, 90, 200), rng.randint(10, 90, 200)
    pts = spark.createDataFrame([("F", i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "fov string, id long, r int, c int")
    n = [r["n"] for r in neighbors.neighbor_count(pts, 5).collect()]
    assert (sum(n), max(n), sum(k > 3 for k in n)) == (658, 8, 76)
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 25
    core = d2.sum(1) >= 4
    out = {r["id"]: r["cluster"] for r in neighbors.dbscan(pts, 5, 4).collect()}
    for i in range(200):
        assert (out[i] == -1) == (not core[d2[i]].any())
        for j in range(200):
            if core[i] and core[j] and d2[i, j]:
                assert out[i] == out[j]
    box = px(spark, square(0, 3, 0, 4)).selectExpr("*", "0 AS cluster")
    ring = neighbors.convex_hulls(box).first()["ring"]
    assert {(p["x"], p["y"]) for p in ring} == {(0, 0), (3, 0), (3, 2), (0, 2)} and ring[0] == ring[-1]


def test_bins(spark):
    pts = spark.createDataFrame([("F", 5, 5, "a"), ("F", 9, 1, "a"), ("F", 15, 5, "b"), ("F", 25, 5, "z")], "fov string, r int, c int, target string")
    rows = {(x["bx"], x["by"]): (x["a"], x["b"], x["total"]) for x in bins.bin_counts(pts, 10, ["a", "b"]).collect()}
    assert rows == {(0, 0): (2, 0, 2), (1, 0): (0, 1, 1), (2, 0): (0, 0, 0)}


def test_catalog_matches_its_sql(spark):
    import duckdb

    from densigrid.plans import catalog

    con, base = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    flat = lambda v: round(v, 4) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    for name in ("region_bulk_counts", "conv_circle", "connected_components", "ring_constrained", "overlap_label_mask", "marker_ttest", "class_regions"):
        df = catalog.queries()[name](spark, base)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(tuple(map(flat, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(flat, r)) for r in want), name


def test_clusters_and_seeds_take_all_points(spark, tmp_path):
    import datetime

    from densigrid.plans import catalog

    rng = np.random.default_rng(21)
    at = {i: (int(rng.integers(0, 60)), int(rng.integers(0, 60)), ["click", "purchase", "view"][i % 3]) for i in range(1, 161)}
    rows = [(i, datetime.datetime(2024, 1, 3), float(r), c, t) for i, (r, c, t) in at.items()]
    spark.createDataFrame(rows, "event_id long, ts timestamp, value double, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    near = {i: [j for j in at if (at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2 <= 25] for i in at}
    cores, root = {i for i in at if len(near[i]) >= 3}, {}
    for i in sorted(cores):
        todo = [i] if i not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += [j for j in near[k] if j in cores]
    of = {i: root[i] if i in cores else root[min(k)] if (k := [j for j in near[i] if j in cores]) else None for i in at}
    names: dict = {}
    for i in sorted(at):
        if of[i] is not None:
            names.setdefault(of[i], len(names))
    assert {r["id"]: r["cluster"] for r in run("dbscan")} == {i: names.get(of[i], -1) for i in at}
    h, w = max(r for r, _, _ in at.values()) + 1, max(c for _, c, _ in at.values()) + 1
    seed = {(r, c) for r, c, t in at.values() if t == "purchase"}
    d2 = {(r, c): min((r - y) ** 2 + (c - x) ** 2 for y, x in seed) for r in range(h) for c in range(w)}
    ring = {p: 2 if d <= 4 else 4 for p, d in d2.items() if 0 < d <= 16}
    assert {(r["r"], r["c"]): r["ring"] for r in run("label_propagation")} == ring
    area = {2: 0, 4: 0}
    for d in area:
        left = {p for p in ring if ring[p] == d}
        while left:
            todo, part = [left.pop()], 1
            while todo:
                y, x = todo.pop()
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in left]:
                    left.remove(q)
                    todo.append(q)
                    part += 1
            area[d] += part if part >= 30 else 0
    assert {r["ring"]: r["area"] for r in run("ring_area_filtered")} == {d: n for d, n in area.items() if n}
    label = {(r, c): r // 50 * 1000 + c // 50 + 1 for r, c in seed}
    kind = lambda n: "A" if n % 2 == 0 else "B"
    seeds = [(s["idx"], s["class"], s["cx"], s["cy"]) for s in run("class_seeds")]
    nearest = lambda y, x: min(((x - cx) ** 2 + (y - cy) ** 2, i, k) for i, k, cx, cy in seeds)[2]
    grown, cover, under = {}, {}, {}
    for n in set(label.values()):
        own = [q for q in seed if label[q] == n]
        for q in own:
            grown.setdefault((kind(n), 0, *q), []).append(n)
            under.setdefault(q, []).append(n)
        for y, x in d2:
            far = min((q[0] - y) ** 2 + (q[1] - x) ** 2 for q in own)
            if 0 < far <= 25 and (len(seeds) < 4 or kind(n) == nearest(y, x)):
                grown.setdefault((kind(n), 3 if far <= 9 else 5, y, x), []).append(n)
                cover.setdefault((y, x), []).append(n)
    want = {k: (max(v), max(cover.get(k[2:]) or under[k[2:]])) for k, v in grown.items()}
    assert {(r["class"], r["ring"], r["r"], r["c"]): (r["label"], r["referenced"]) for r in run("class_limited_rings")} == want
