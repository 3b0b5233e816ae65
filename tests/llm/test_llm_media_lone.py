"""Entries of one block are not joined with themselves, and no pair is lost where entries have several."""

import numpy as np
import pytest

media_copies = pytest.importorskip("densigrid.llm.media_copies")


def test_entries_of_one_block_stay_out_of_the_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 256, (9, 12, media_copies.BITS // 8), dtype=np.uint8)
    bits[:6, :2] = bits[0, :2]  # six copies, of two descriptors
    bits[6:8, 2:5] = bits[6, 2:5]
    bits[8, 0, :4] = bits[0, 0, :4]  # shares one entry, with a descriptor that is far
    table = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in enumerate(bits)], "node long, bits binary")
    rows = spark.createDataFrame([(int(k), i) for i, b in enumerate(bits) for k in np.unique(media_copies.entries(b))], "key long, node long")
    want = [(a, b) for b in range(6) for a in range(b)] + [(6, 7)]
    places, written = {}, media_copies.written

    def seen(df, label):
        out = written(df, label)
        if label == "media-blocks":
            for r in out.select("key", "place").collect():
                places.setdefault(r["key"], []).append(r["place"])
        return out

    monkeypatch.setattr(media_copies, "written", seen)
    for block in (64, 2):
        places.clear()
        monkeypatch.setattr(media_copies, "BLOCK", block)
        found = media_copies._rest_pairs(rows, None, table, rows.count()).collect()
        assert sorted(tuple(r) for r in found) == sorted(want)
        lone = [k for k, v in places.items() if v == [media_copies.LONE]]
        assert len(lone) == (len(places) if block == 64 else len(places) - 8)
