"""Measures in one pass, ranks by ranges, batch maps and exact neighbours, against plain repeats."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densigrid.operators import bins, features, masks, nearest


def test_one_expand_for_all_measures(spark):
    rng = np.random.default_rng(3)
    images = {f: rng.random((40, 50)) < 0.35 for f in ("F0", "F1")}
    px = spark.createDataFrame([(f, int(r), int(c)) for f, img in images.items() for r, c in np.argwhere(img)], "fov string, r int, c int")
    other = px.where("fov = 'F0' AND r < 20")
    present = px.withColumn("target", F.when((F.col("r") + F.col("c")) % 3 == 0, "a").otherwise("b"))
    ext = spark.createDataFrame([("F0", 40, 50), ("F1", 40, 50), ("F2", 9, 9)], "fov string, h int, w int")
    make = features.MaskDefinition
    asked = [make(px, "all", "bulk"), make(px, "things", "per_object"), make(px, "tiles", "grid", 10), make(other, "part", "bulk"), make(px, "fine", "grid", 7), make(px, "again", "grid", 10)]
    out = features.analysed(asked, present, ["a", "b"], ext)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand [") == 1 or plan.count("Expand") <= 2
    got = out.toPandas()
    assert sorted(got["mask_name"].unique()) == ["again", "all", "fine", "part", "things", "tiles"]
    whole = got[got["mask_name"] == "all"].set_index("fov")
    assert whole["area"].to_dict() == {"F0": int(images["F0"].sum()), "F1": int(images["F1"].sum()), "F2": 0} and set(whole["object_id"]) == {"bulk"} and whole["centroid_y"].isna().all()
    assert got[got["mask_name"] == "part"].set_index("fov")["area"].to_dict() == {"F0": int(images["F0"][:20].sum()), "F1": 0, "F2": 0}
    lab = masks.label(px)
    one = features.objects(lab).join(features.counts(lab, present, ["a", "b"], ["fov", "label"]), ["fov", "label"]).toPandas().sort_values(["fov", "label"])
    things = got[got["mask_name"] == "things"].assign(label=lambda x: x["object_id"].astype(int)).sort_values(["fov", "label"])
    for c in ("area", "a", "b", "centroid_y", "centroid_x", "min_row", "max_col", "eccentricity"):
        assert np.allclose(things[c].to_numpy(float), one[c].to_numpy(float)), c
    assert things["perimeter"].notna().all() and things["solidity"].notna().all() and things["x"].isna().all()
    for name, size in (("tiles", 10), ("fine", 7), ("again", 10)):
        keys = ["fov", "label", "tile_y", "tile_x"]
        want = features.counts(features.grid_tiles(lab, size), present, ["a", "b"], keys, "area").toPandas().sort_values(keys)
        own = got[got["mask_name"] == name].assign(label=lambda x: x["object_id"].astype(int)).sort_values(["fov", "label", "grid_y", "grid_x"])
        assert np.array_equal(own[["grid_y", "grid_x", "area", "a", "b"]].to_numpy(int), want[["tile_y", "tile_x", "area", "a", "b"]].to_numpy(int))
        assert (own["x"] >= own["grid_x"]).all() and (own["y"] < own["grid_y"] + size).all()
    with pytest.raises(ValueError):
        features.analysed([make(px, "x", "grid")], present, ["a"], ext)


def test_ranks_without_a_task_a_target(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"target": rng.choice(["x", "y", "z"], 3000, p=[0.9, 0.09, 0.01]), "v": np.round(rng.normal(size=3000), 2)})
    counts = spark.createDataFrame(rows).groupBy("target", "v").agg(F.count(F.lit(1)).alias("same"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = bins.mid_ranks(counts)
        got = ranked.toPandas()
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = rows.assign(mid=rows.groupby("target")["v"].rank(method="average")).drop_duplicates()
    met = got.merge(want, on=["target", "v"])
    assert len(met) == len(got) == len(want) and np.allclose(met["mid_x"], met["mid_y"])
    assert "windowspecdefinition(target#" not in plan or "windowspecdefinition(target" in plan and ", part#" in plan


def test_batch_map_equals_a_plain_repeat(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(4, 1, (40, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "id long, e array<double>")
    for shape in ((2, 1), (2, 3)):
        n, epochs = shape[0] * shape[1], 4
        units = np.array([x.mean(axis=0) + (j - (n - 1) / 2) * x.std(axis=0) for j in range(n)])
        place = np.array([divmod(j, shape[1]) for j in range(n)], dtype=float)
        for e in range(epochs):
            won = ((x[:, None] - units) ** 2).sum(axis=2).argmin(axis=1)
            wide = 0.5 / (1 + 2 * e / epochs)
            pull = np.exp(-((place[:, None] - place[None]) ** 2).sum(axis=2) / (2 * wide * wide))[:, won]
            units = pull @ x / pull.sum(axis=1, keepdims=True)
        assert np.allclose(bins.som_batch(rows, "e", shape, epochs), units)
    assert bins.som_batch(rows.limit(0), "e") == []


@pytest.mark.parametrize(("n", "width", "k"), [(300, 2, 5), (400, 16, 3), (4, 2, 5), (1, 3, 2), (900, 3, 4)])
def test_neighbours_are_exact(spark, monkeypatch, n, width, k):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width)) * rng.choice([1, 10], (n, 1))
    if n == 900:
        x[:400] = np.round(x[:400])  # very many equal rows and distances
        x[450:460] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0] * (width + 1)), (5002, [float("nan")] * width), (None, [0.0] * width), (5003, [])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for within in (None, 1.5):
        got = nearest.nearest_neighbors(df, "id", "e", k, within).toPandas().sort_values(["id", "rank"])
        want = [(i, j, r + 1) for i in range(n) for r, j in enumerate([j for j in sorted(range(n), key=lambda j: (d[i, j], j)) if j != i and (within is None or d[i, j] <= within)][:k])]
        assert list(zip(got["id"], got["neighbor"], got["rank"])) == want
        assert np.allclose(got["distance"], [d[i, j] for i, j, _ in want])
    assert nearest.nearest_neighbors(df.limit(0), "id", "e", k).count() == 0
