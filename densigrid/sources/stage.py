"""Intermediate tables that cut the lineage of what is built in steps."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()  # of this process's applications, deleted when it ends


def _folder(spark: SparkSession) -> str:
    """A folder of this application's own in the one that spark.checkpoint.dir names. Where that is unset a local master gets a temporary folder; a cluster is refused."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="densigrid-")
        context.setCheckpointDir(shared)
    folder = f"{shared.rstrip('/')}/stages-{context.applicationId}-{os.getpid()}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_cleared, folder)
    return folder


def _cleared(folder: str) -> None:
    import pyarrow as pa
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)
    except (OSError, pa.ArrowException) as e:
        logging.getLogger(__name__).warning("%s stays: %s", folder, e)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut, a lost executor costs a reread, readers take the columns they need, and joins know its size.

    What an application has written is deleted when the driver's process ends, or can be with the folder when it was killed.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
