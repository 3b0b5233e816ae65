"""Blocks of an entry carry the descriptors that are in it, not the images' other ones."""

import numpy as np
import pytest

media_copies = pytest.importorskip("densigrid.llm.media_copies")


def test_blocks_carry_an_entrys_descriptors_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 256, (3, 40, media_copies.BITS // 8), dtype=np.uint8)
    bits[:, :2, :4] = 7  # two descriptors of each image in one entry, near each other in two images
    bits[:2, :2, 4:8] = 9
    bits[1, :2] = bits[0, :2]
    bits[2, :2, 8:] = ~bits[0, :2, 8:]
    keys = media_copies.entries(bits[0])
    for key in (keys[0, 0], keys[5, 2], keys[39, 3]):
        (got,) = media_copies._cut(np.array([key]), bits[0].tobytes())
        assert got == bits[0][(keys == key).any(axis=1)].tobytes()
    table = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in enumerate(bits)], "node long, bits binary")
    rows = spark.createDataFrame([(int(k), i) for i, b in enumerate(bits) for k in np.unique(media_copies.entries(b))], "key long, node long")
    sizes, written = [], media_copies.written

    def seen(df, label):
        out = written(df, label)
        if label == "media-blocks":
            sizes.extend(len(v) for r in out.collect() for m in r["members"] for v in m if isinstance(v, (bytes, bytearray)))
        return out

    monkeypatch.setattr(media_copies, "written", seen)
    found = media_copies._rest_pairs(rows, None, table, rows.count())
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    assert sizes and max(sizes) <= 2 * media_copies.BITS // 8  # before: 40 descriptors a member
