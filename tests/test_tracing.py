"""Rings traced by edges against border following."""

import numpy as np
import pandas as pd
import pytest
from following import borders

from densigrid.operators import contours, neighbors, tracing
from densigrid.operators.runs import runs


def pixels(spark, images):
    px = [(f, int(r), int(c)) for f, img in images.items() for r, c in np.argwhere(img)]
    return spark.createDataFrame(pd.DataFrame(px, columns=["fov", "r", "c"]), "fov string, r int, c int")


def expected(img):
    """{(first pixel, is it a hole's, closed ring)} of an image, rings of three corners or more."""
    out = []
    for hole, ring in borders(img):
        kept = tracing.corners_only(ring)
        if len(kept) >= 3:
            out.append((ring[0], hole, [(x, y) for y, x in (*kept, kept[0])]))
    return sorted(out)


def pictures():
    rng = np.random.default_rng(5)
    out = {f"n{k}": rng.random(rng.integers(1, 26, 2)) < rng.uniform(0.2, 0.9) for k in range(40)}
    rows, cols = np.mgrid[:70, :60]
    spiral = (np.hypot(rows - 35, cols - 30) / 3 + np.arctan2(rows - 35, cols - 30) / np.pi * 1.5) % 3 < 1.6  # one border through many strips, many times
    comb = (cols % 3 != 1) | (rows == 69)
    return out | {"spiral": spiral, "comb": comb, "rings": np.hypot(rows - 35, cols - 30) % 6 < 3, "full": np.ones((40, 33), dtype=bool), "dots": (rows + cols) % 2 == 0, "point": rows + cols == 0}


@pytest.mark.parametrize("strip", [512, 7, 1])
def test_rings_equal_border_following(spark, monkeypatch, strip):
    monkeypatch.setattr(tracing, "STRIP", strip)
    images = pictures()
    got = contours.trace(pixels(spark, images)).toPandas().sort_values(["fov", "ring_id"])
    for fov, img in images.items():
        own = got[got["fov"] == fov]
        rings = [(bool(h), [(p["x"], p["y"]) for p in ring]) for h, ring in zip(own["hole"], own["ring"])]
        assert sorted(rings) == sorted((h, r) for _, h, r in expected(img)), fov
        assert list(own["ring_id"]) == list(range(1, len(own) + 1))
        assert [r for _, r in rings] == [r for _, _, r in expected(img)], fov  # by first pixel, outer before hole


def test_keys_are_traced_apart(spark, monkeypatch):
    monkeypatch.setattr(tracing, "STRIP", 4)
    rng = np.random.default_rng(6)
    images = {k: rng.random((15, 12)) < 0.6 for k in (0, 3, -2)}  # they overlap and touch
    rows = pd.DataFrame([("F", k, int(r), int(c), int(c)) for k, img in images.items() for r, c in np.argwhere(img)], columns=["fov", "cluster", "r", "c0", "c1"])
    got = tracing.trace_runs(runs(spark.createDataFrame(rows[rows["cluster"] == 3].assign(c=rows["c0"])[["fov", "r", "c"]], "fov string, r int, c int")).selectExpr("fov", "3 AS cluster", "r", "c0", "c1").unionByName(
        spark.createDataFrame(rows[rows["cluster"] != 3], "fov string, cluster int, r int, c0 int, c1 int")), "cluster").toPandas()
    for k, img in images.items():
        # runs of one pixel each touch, so they are as good as a run of all
        assert sorted([(p["x"], p["y"]) for p in ring] for ring in got[got["cluster"] == k]["ring"]) == sorted(r for _, _, r in expected(img))


def test_ranks_of_cycles(spark):
    links, want = [], {}
    for cycle in ([5], [3, 9], [7, 1, 8, 2, 6], list(range(100, 133))):
        at = cycle.index(min(cycle))
        for i, node in enumerate(cycle):
            links.append((node, cycle[(i + 1) % len(cycle)]))
            want[node] = (min(cycle), (at - i) % len(cycle))
    rows = spark.createDataFrame(links, "a long, b long").selectExpr("'F' AS fov", "struct(a AS key, 0 AS r, 0 AS c, 0 AS side) AS id", "struct(b AS key, 0 AS r, 0 AS c, 0 AS side) AS next")
    assert {r["id"]["key"]: (r["name"]["key"], r["far"]) for r in tracing.ranked(rows).collect()} == want


def test_nothing_to_trace(spark):
    assert contours.trace(pixels(spark, {"F": np.zeros((3, 3), dtype=bool)})).count() == 0
    assert neighbors.RING == contours.RING
