"""Components, holes and rings over tiles that are cut along columns too."""

import numpy as np
import pytest
from test_operators import ext, flood, got, px
from test_tracing import expected, pictures, pixels

from densigrid.operators import contours, masks, runs, tracing


def narrow(monkeypatch, rows, columns):
    for module in (runs, tracing):
        monkeypatch.setattr(module, "STRIP", rows)
        monkeypatch.setattr(module, "PART", columns)


@pytest.mark.parametrize(("rows", "columns", "eight"), [(3, 4, True), (4, 3, False), (512, 1, True)])
def test_components_over_tiles(spark, monkeypatch, rows, columns, eight):
    narrow(monkeypatch, rows, columns)
    rng = np.random.default_rng(rows)
    img = (rng.random((17, 14)) < 0.55) * rng.integers(1, 3, (17, 14))
    for value in (None, "value"):
        of = flood(img if value else (img > 0).astype(int), eight)
        number = {p: i for i, p in enumerate(sorted(set(of.values())), 1)}
        assert {(x["r"], x["c"]): x["label"] for x in masks.label(px(spark, img, "value"), eight, value).collect()} == {p: number[q] for p, q in of.items()}
    back = np.pad((img == 0).astype(int), 1, constant_values=1)
    outside = flood(back, False)
    assert got(masks.holes(px(spark, img), ext(spark, *img.shape))) == {(r - 1, c - 1) for (r, c), q in outside.items() if q != (0, 0)}


def test_rings_over_tiles(spark, monkeypatch):
    narrow(monkeypatch, 7, 6)
    images = pictures()
    found = contours.trace(pixels(spark, images)).toPandas().sort_values(["fov", "ring_id"])
    for fov, img in images.items():
        own = found[found["fov"] == fov]
        assert [(bool(h), [(p["x"], p["y"]) for p in ring]) for h, ring in zip(own["hole"], own["ring"])] == [(h, r) for _, h, r in expected(img)], fov
        assert list(own["ring_id"]) == list(range(1, len(own) + 1))


def test_no_group_spans_the_columns(spark):
    """A tile, not a strip of all columns, is what a task labels and traces."""
    wide = spark.range(0, 20_000, 2).selectExpr("'F' AS fov", "cast(0 AS int) AS r", "cast(id AS int) AS c")
    found = runs.runs(wide)
    assert found.groupBy("fov", "strip", "part").count().agg({"count": "max"}).collect()[0][0] <= runs.PART // 2
    assert masks.label(wide).agg({"label": "max"}).collect()[0][0] == 10_000
