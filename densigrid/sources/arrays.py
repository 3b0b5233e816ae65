"""Array files (npy) as a data source: one file a field of view, read in strips, written from rows of file bytes.

``spark.read.format("npy").load(folder)`` gives (fov, r, c, v) of the values that aren't 0, fov being the file's name without its ending. A file has as many partitions as it
has strips of ``stripBytes``, so no task holds an image; the option ``fovs``, a JSON list, leaves other files unopened. (Filters aren't pushed to the file list: this version
of Spark keeps a pushed filter with the table, and would apply it to later queries of the same DataFrame.) ``rows.write.format("npy").save(folder)`` takes
(fov, data), the bytes of whole files, and replaces files of the same names once they are complete.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ENDING = ".npy"
STRIP_BYTES = 8 << 20
READ = "fov string, r int, c int, v double"


def _store(path: str):
    """(file system, path within it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


@dataclass
class Strip(InputPartition):
    """Rows ``lo`` to ``hi`` of an array as it lies in a file; ``turned`` if these are its columns."""

    path: str
    fov: str
    kind: str
    start: int
    width: int
    lo: int
    hi: int
    turned: bool


def header(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, does it lie by columns, kind, where the values start) from the first bytes of a file."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    shape, turned, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return shape, turned, kind, f.tell()


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, strip_bytes: int, only: list[str] | None = None):
        self.path, self.strip_bytes, self.only = path, strip_bytes, only

    def partitions(self) -> list[Strip]:
        from pyarrow import fs

        store, folder = _store(self.path)
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
            fov = os.path.basename(info.path).removesuffix(ENDING)
            if not info.is_file or not info.path.endswith(ENDING) or (self.only is not None and fov not in self.only):
                continue
            with store.open_input_file(info.path) as f:
                shape, turned, kind, start = header(f.read(4096))
            if len(shape) != 2 or kind.hasobject:
                raise ValueError(f"{info.path} holds no plain array of two axes")
            h, w = shape[::-1] if turned else shape
            rows = max(1, self.strip_bytes // max(1, w * kind.itemsize))
            out += [Strip(info.path, fov, kind.str, start, w, lo, min(lo + rows, h), turned) for lo in range(0, h, rows) if w]
        return out

    def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        kind = np.dtype(partition.kind)
        with store.open_input_file(partition.path) as f:
            f.seek(partition.start + partition.lo * partition.width * kind.itemsize)
            raw = f.read((partition.hi - partition.lo) * partition.width * kind.itemsize)
        values = np.frombuffer(raw, dtype=kind).reshape(-1, partition.width)
        if len(values) < partition.hi - partition.lo:
            raise OSError(f"{partition.path} is cut short")
        a, b = np.nonzero(values)
        v = values[a, b].astype(np.float64)
        a = (a + partition.lo).astype(np.int32)
        r, c = (b.astype(np.int32), a) if partition.turned else (a, b.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([partition.fov] * len(v), pa.string()), pa.array(r), pa.array(c), pa.array(v)], names=["fov", "r", "c", "v"])


class ArrayWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Files under names of their own, which commit() gives the right ones; a task that is run again leaves files that no one asks for."""
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        message = WriterCommitMessage()
        message.files = []
        for row in iterator:
            part = f"{folder}/.{row['fov']}.{self.run}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row["data"])
            message.files.append((part, f"{folder}/{row['fov']}{ENDING}"))
        return message

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        done = {name: part for m in messages if m for part, name in m.files}
        for name, part in done.items():
            store.move(part, name)
        for info in store.get_file_info(fs.FileSelector(folder)):
            ours = f".{self.run}." in os.path.basename(info.path)
            if ours or (self.overwrite and info.path.endswith(ENDING) and info.path not in done):
                store.delete_file(info.path)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f".{self.run}." in os.path.basename(info.path):
                store.delete_file(info.path)


class ArrayFiles(DataSource):
    """Options: path; stripBytes, the most that a task reads; fovs, a JSON list of those to read."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> ArrayReader:
        only = self.options.get("fovs")
        return ArrayReader(self.options["path"], int(self.options.get("stripBytes", STRIP_BYTES)), None if only is None else json.loads(only))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        if {"fov", "data"} - set(schema.names):
            raise ValueError("array files are written from columns fov and data")
        return ArrayWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ArrayFiles)


def read_arrays(spark: SparkSession, folder: str, fovs: list[str] | None = None, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """(fov, r, c, v) of the array files in a folder, or of those of some fovs."""
    register(spark)
    reader = spark.read.format("npy").option("stripBytes", strip_bytes)
    return (reader if fovs is None else reader.option("fovs", json.dumps(fovs))).load(folder)
