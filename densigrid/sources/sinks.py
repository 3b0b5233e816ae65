"""Where masks, labels and results go: Parquet by mask, CSV, and array or image files of single fields of view."""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def write_labels(labelled: DataFrame, path: str) -> None:
    """Parquet with a folder a fov; a run on some fovs replaces only theirs."""
    labelled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fov").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def not_done(points: DataFrame, done: DataFrame) -> DataFrame:
    """Points of fovs that have no result in ``done`` yet; the list of done fovs is one row a fov."""
    return points.join(done.select("fov").distinct(), "fov", "left_anti")


def mask_files(mask: DataFrame, ext: DataFrame, kind: str = "npy") -> DataFrame:
    """(fov, data): each fov's mask as a file's bytes: ``npy`` (uint8, 0 and 1) or ``pgm`` (0 and 255). One fov is one task; empty masks have no row."""
    if kind not in ("npy", "pgm"):
        raise ValueError(f"unknown file kind {kind!r}")

    def work(px: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(px["h"].iloc[0]), int(px["w"].iloc[0])), dtype=np.uint8)
        img[px["r"], px["c"]] = 1
        out = io.BytesIO()
        if kind == "npy":
            np.save(out, img)
        else:
            out.write(b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + (img * 255).tobytes())
        return pd.DataFrame({"fov": pd.Series([px["fov"].iloc[0]], dtype=object), "data": [out.getvalue()]})

    return mask.select("fov", "r", "c").join(ext, "fov").groupBy("fov").applyInPandas(work, "fov string, data binary")


def save_mask_files(mask: DataFrame, ext: DataFrame, folder: str, kind: str = "npy") -> None:
    """One file a fov in a folder that driver and executors share; a task that runs again replaces its files."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            name = os.path.join(folder, f"{row['fov']}.{kind}")
            with open(f"{name}.{os.getpid()}", "wb") as f:
                f.write(row["data"])
            os.replace(f"{name}.{os.getpid()}", name)

    mask_files(mask, ext, kind).foreachPartition(put)
