"""Distance transforms against the search within a reach and against all pairs."""

import time

import numpy as np
import pandas as pd
import pytest

from densigrid.operators import distance, expand


def frame(spark, images, keys=()):
    rows = [(*k, int(r), int(c), int(img[r, c])) for k, img in images.items() for r, c in np.argwhere(img)]
    kinds = ", ".join([*(f"{k} string" for k in keys), "fov string", "r int", "c int", "label int"])
    return spark.createDataFrame(pd.DataFrame(rows, columns=[*keys, "fov", "r", "c", "label"]), kinds)


@pytest.mark.parametrize("reach", [1, 6, 30, 90])
def test_transform_equals_the_search(spark, monkeypatch, reach):
    monkeypatch.setattr(distance, "TALL", 16)
    monkeypatch.setattr(distance, "WIDE", 8)
    rng = np.random.default_rng(reach)
    images = {}
    for k, share in enumerate((0.001, 0.01, 0.1, 0.6)):
        img = (rng.random((70, 50)) < share) * rng.integers(1, 4, (70, 50))
        img[rng.integers(0, 70), rng.integers(0, 50)] = 2
        images[("ab"[k % 2], f"F{k}")] = img
    images[("b", "F0")] = np.pad(np.ones((20, 30), dtype=int), ((10, 40), (5, 15)))
    src = frame(spark, images, ("key",))
    ext = spark.createDataFrame([(f"F{k}", 70, 50) for k in range(4)], "fov string, h int, w int")
    columns = ["key", "fov", "r", "c", "d2", "sr", "sc", "label"]
    got = distance.transform(src, ext, reach, "key").select(*columns).toPandas().sort_values(columns[:4], ignore_index=True)
    for (key, fov), img in images.items():
        at = np.argwhere(img)
        yy, xx = np.mgrid[:70, :50]
        d2 = (yy[..., None] - at[:, 0]) ** 2 + (xx[..., None] - at[:, 1]) ** 2
        best = d2.argmin(axis=2)  # the first in raster order
        near = np.take_along_axis(d2, best[..., None], 2)[..., 0]
        own = got[(got["key"] == key) & (got["fov"] == fov)]
        r, c = np.nonzero((near > 0) & (near <= reach * reach))
        assert np.array_equal(own[columns[2:]].to_numpy(), np.column_stack([r, c, near[r, c], at[best[r, c]], img[tuple(at[best[r, c]].T)]]))
    if reach == 6:
        other = expand.nearest_within(src, ext, reach, "key").select(*columns).toPandas().sort_values(columns[:4], ignore_index=True)
        assert np.array_equal(got.to_numpy(), other.to_numpy())


def test_several_labels_at_a_pixel_and_no_sources(spark):
    ext = spark.createDataFrame([("F", 3, 3)], "fov string, h int, w int")
    src = spark.createDataFrame([("F", 1, 1, 7), ("F", 1, 1, 3)], "fov string, r int, c int, label int")
    assert {r["label"] for r in distance.transform(src, ext, 5).collect()} == {3}
    assert distance.transform(src.limit(0), ext, 5).count() == 0 and distance.transform(src.drop("label"), ext, 1).count() == 4


def test_a_long_reach_costs_what_a_short_one_does():
    rng = np.random.default_rng(1)
    r, c = np.nonzero(rng.random((distance.TALL, distance.WIDE)) < 0.002)

    def block(reach):
        rows = []
        for y in np.unique(r):
            at = np.sort(c[r == y])
            mid = (at[:-1] + at[1:]) // 2
            for a, lo, hi in zip(at, np.r_[0, mid + 1], np.r_[mid, distance.WIDE - 1]):
                rows.append((y, a, a, 1, max(lo, a - reach), min(hi, a + reach), distance.TALL, distance.WIDE, 0, 0))
        px = pd.DataFrame(rows, columns=["r", "c0", "c1", "label", "lo", "hi", "h", "w", "y0", "x0"])
        began = time.perf_counter()
        made = distance._nearest(px, reach, distance.TALL, distance.WIDE)
        return time.perf_counter() - began, len(made["r"])

    block(30)
    (short, some), (long, all_) = block(30), block(500)
    assert all_ == distance.TALL * distance.WIDE - len(r) and some < all_
    assert long < 8 * short + 0.5
