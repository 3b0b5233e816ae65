"""Array files: round trips, strips, and files that filters leave alone."""

import os

import numpy as np
import pytest

from densigrid.sources import arrays, sinks


def test_round_trip_of_masks(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"F{k}": rng.random((37 + k, 23)) < 0.3 for k in range(3)}
    px = spark.createDataFrame([(f, int(r), int(c)) for f, img in images.items() for r, c in np.argwhere(img)], "fov string, r int, c int")
    ext = spark.createDataFrame([(f, *img.shape) for f, img in images.items()], "fov string, h int, w int")
    arrays.register(spark)
    folder = f"{tmp_path}/masks"
    sinks.mask_files(px, ext).write.format("npy").mode("append").save(folder)
    assert {f: np.load(f"{folder}/{f}.npy").shape for f in images} == {f: img.shape for f, img in images.items()} and len(os.listdir(folder)) == 3
    got = arrays.read_arrays(spark, folder, strip_bytes=100)
    assert {(x["fov"], x["r"], x["c"]) for x in got.collect()} == {tuple(x) for x in px.collect()} and got.where("v <> 1").count() == 0
    assert got.rdd.getNumPartitions() > 20  # several strips a file
    sinks.mask_files(px.where("fov = 'F1'"), ext).write.format("npy").mode("overwrite").save(folder)
    assert os.listdir(folder) == ["F1.npy"]


def test_kinds_and_layouts(spark, tmp_path):
    rng = np.random.default_rng(2)
    held = {
        "floats": rng.normal(size=(9, 14)) * (rng.random((9, 14)) < 0.5), "columns": np.asfortranarray(rng.integers(0, 3, (8, 5)).astype(np.int16)), "flags": rng.random((4, 4)) < 0.5,
        "wide": rng.integers(0, 2, (1, 3000)).astype(np.uint8), "empty": np.zeros((0, 4)), "none": np.zeros((4, 0)), "big": rng.integers(0, 2**31, (3, 3)).astype(">i8"),
    }
    for name, img in held.items():
        np.save(f"{tmp_path}/{name}.npy", img)
    (tmp_path / "other.txt").write_text("not an array")
    for strip in (1, 64, 1 << 20):
        rows = arrays.read_arrays(spark, str(tmp_path), strip_bytes=strip).toPandas()
        for name, img in held.items():
            made, own = np.zeros(img.shape), rows[rows["fov"] == name]
            made[own["r"], own["c"]] = own["v"]
            assert np.array_equal(made, img.astype(float)), name


def test_other_files_stay_unopened(spark, tmp_path):
    for k in range(6):
        np.save(f"{tmp_path}/F{k}.npy", np.full((3, 3), k + 1))
    (tmp_path / "F9.npy").write_bytes(b"not an array")  # whoever opens it fails
    rows = arrays.read_arrays(spark, str(tmp_path), ["F1", "F3", "F7"])
    assert rows.where("fov = 'F3'").agg({"v": "sum"}).first()[0] == 36
    assert rows.where("fov IN ('F1', 'F2') AND v > 2").count() == 0 and rows.count() == 18  # each query by its own filter
    assert [p.fov for p in arrays.ArrayReader(str(tmp_path), 1 << 20, ["F1"]).partitions()] == ["F1"]
    with pytest.raises(Exception, match="magic|array"):
        arrays.read_arrays(spark, str(tmp_path)).count()


def test_arrays_of_three_axes_and_short_files(spark, tmp_path):
    np.save(f"{tmp_path}/cube.npy", np.ones((2, 2, 2)))
    with pytest.raises(Exception, match="two axes"):
        arrays.read_arrays(spark, str(tmp_path)).count()
    np.save(f"{tmp_path}/cube.npy", np.ones((20, 20)))
    data = (tmp_path / "cube.npy").read_bytes()
    (tmp_path / "cube.npy").write_bytes(data[:-100])
    with pytest.raises(Exception, match="cut short|reshape"):
        arrays.read_arrays(spark, str(tmp_path)).count()
