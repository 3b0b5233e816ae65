"""Nearest seeds by the index and finite cells, against all seeds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densigrid.operators import expand, regions, triangulation


def seeds_of(spark, fields):
    rows = [(f, i, "ABC"[i % 3], float(x), float(y)) for f, at in fields.items() for i, (x, y) in enumerate(at)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["fov", "idx", "class", "cx", "cy"]), "fov string, idx int, class string, cx double, cy double")


def extent(spark, **sizes):
    return spark.createDataFrame([(f, *s) for f, s in sizes.items()], "fov string, h int, w int")


@pytest.mark.parametrize("cells", [(16384, 4096, 1024, 256, 64, 16), (64, 16, 4), (8, 2)])
def test_nearest_seeds_by_the_index(spark, monkeypatch, cells):
    monkeypatch.setattr(regions, "CELLS", cells)
    rng = np.random.default_rng(4)
    h, w = 90, 120
    clumped = np.concatenate([rng.normal((30, 20), 2, (150, 2)), rng.uniform((0, 0), (w, h), (10, 2))])
    lattice = np.array([(x, y) for x in range(5, w, 10) for y in range(5, h, 10)], dtype=float)  # very many ties
    fields = {"F0": rng.uniform((-5, -5), (w + 5, h + 5), (40, 2)), "F1": clumped, "F2": lattice, "F3": [(7.5, 3.25)], "F4": [(400.0, -90.0), (500.0, 20.0)]}
    px = spark.range(h * w).select(F.explode(F.array(*map(F.lit, [*fields, "none"]))).alias("fov"), F.floor(F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c"))
    got = regions.class_regions(px, seeds_of(spark, fields), extent(spark, **dict.fromkeys([*fields, "none"], (h, w)))).toPandas()
    yy, xx = np.mgrid[:h, :w]
    assert len(got) == len(fields) * h * w
    for f, at in fields.items():
        at = np.asarray(at)
        best = np.argmin((xx[..., None] - at[:, 0]) ** 2 + (yy[..., None] - at[:, 1]) ** 2, axis=2)  # the first of equals
        own = got[got["fov"] == f]
        assert (np.array(list("ABC"))[best % 3][own["r"], own["c"]] == own["class"]).all()


def test_a_hundred_thousand_seeds(spark):
    rng = np.random.default_rng(5)
    n, side = 100_000, 1500
    at = np.unique(rng.uniform(0, side, (n, 2)), axis=0)
    seeds = spark.createDataFrame(pd.DataFrame({"fov": "F", "idx": np.arange(len(at)), "class": np.where(np.arange(len(at)) % 2, "A", "B"), "cx": at[:, 0], "cy": at[:, 1]}), "fov string, idx int, class string, cx double, cy double")
    few = [tuple(map(int, p)) for p in rng.integers(0, side, (400, 2))]
    px = spark.createDataFrame([("F", *p) for p in set(few)], "fov string, r int, c int")
    got = regions.class_regions(px, seeds, extent(spark, F=(side, side))).collect()
    assert len(got) == len(set(few))
    for x in got:
        assert x["class"] == "BA"[np.argmin((at[:, 0] - x["c"]) ** 2 + (at[:, 1] - x["r"]) ** 2) % 2]
    assert regions.candidates(seeds, extent(spark, F=(side, side))).count() < 40 * n  # not a tile with all seeds


def test_finite_cells_cut_to_the_image(spark):
    rng = np.random.default_rng(6)
    h, w = 60, 80
    fields = {"F0": rng.uniform((0, 0), (w, h), (12, 2)), "F1": [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (9.0, 9.0)], "F2": [(3.0, 3.0), (9.0, 9.0)]}
    seeds, size = seeds_of(spark, fields), extent(spark, F0=(h, w), F1=(h, w), F2=(h, w))
    rings = regions.finite_regions(seeds, size).collect()
    assert {r["fov"] for r in rings} == {"F0"} and len(rings) == 12
    cells = triangulation.finite_cells(*fields["F0"].T)
    for r in rings:
        cell = np.trunc(np.clip(cells[r["idx"]], 0, (w - 1, h - 1)))
        assert [(p["x"], p["y"]) for p in r["ring"]] == [tuple(map(int, p)) for p in (*cell, cell[0])]
    held = {(x["class"], x["r"], x["c"]) for x in regions.clamped_regions(seeds, size).collect()}
    # well inside the cells that have an end within the image, the regions are those of the nearest seeds
    at = fields["F0"]
    inner = [k for k, cell in enumerate(cells) if ((cell >= 0) & (cell <= (w - 1, h - 1))).all()]
    assert inner
    for y in range(h):
        for x in range(w):
            d = np.hypot(at[:, 0] - x, at[:, 1] - y)
            k, other = np.argsort(d)[:2]
            if k in inner and d[other] - d[k] > 3:
                assert ("ABC"[k % 3], y, x) in held and not any((c, y, x) in held for c in set("ABC") - {"ABC"[k % 3]})


def test_growth_within_finite_cells(spark):
    own = spark.createDataFrame([("F", 20, 20, 1, "A"), ("F", 20, 40, 2, "B"), ("G", 5, 5, 3, "A")], "fov string, r int, c int, parent int, class string")
    seeds = spark.createDataFrame([("F", i, c, float(x), float(y)) for i, (c, x, y) in enumerate([("A", 20, 20), ("B", 40, 20), ("A", 20, 45), ("B", 40, 47), ("A", 5, 5)])], "fov string, idx int, class string, cx double, cy double")
    size = extent(spark, F=(60, 60), G=(12, 12))
    rows = expand.class_limited_rings(own, size, seeds, [14], "clamped").where("ring > 0").collect()
    held = {(x["class"], x["r"], x["c"]) for x in regions.clamped_regions(seeds, size).collect()}
    assert {(x["class"], x["r"], x["c"]) for x in rows if x["fov"] == "F"} == {(k, r, c) for k, r, c in held if 0 < (r - 20) ** 2 + (c - {"A": 20, "B": 40}[k]) ** 2 <= 196}
    assert len([x for x in rows if x["fov"] == "G"]) == 12 * 12 - 1  # no seeds, no limits
    with pytest.raises(ValueError):
        expand.class_limited_rings(own, size, seeds, [3], "other")
