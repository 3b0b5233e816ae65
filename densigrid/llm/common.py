"""Helpers that the training-data operators share: tables, written intermediates, joins that stand hot keys, and columns computed beside a packed row."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 4096  # no more keys than this are ever treated as hot: a hot key holds at least so large a share of the rows
HOT_ROWS = 1 << 16  # and so many rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder; a cluster is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="densigrid-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def file_store(path: str):
    """(file system, path within it) of a URI or a local path, for Python code on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it cuts the lineage and is read again, not computed again, when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made, once everything that reads them has been written itself. What can't be deleted stays, with a warning."""
    for t in tables:
        path = getattr(t, "written_to", None) if t is not None else None
        if path:
            try:
                store, inner = file_store(path)
                store.delete_dir(inner)
            except (OSError, pa.ArrowException) as e:
                logging.getLogger(__name__).warning("%s stays: %s", path, e)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get no more than so many rows at a time in what runs within; the session's own number, where it is less, holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def blocks_of(n: int, size: int) -> int:
    """How many blocks of ``size`` hold ``n`` rows, at least one."""
    return max(1, -(-n // size))


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is dealt by key and never broadcast. Spark guesses sizes from compressed files, and as if an explode made one row of each: far too small,
    and a broadcast is built in the driver."""
    return rows.hint("merge")


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(_hot, _ways): keys of at least max(HOT_ROWS, total / HOT_KEYS) of the ``total`` rows, so at most HOT_KEYS keys, and into how many parts to deal each."""
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    return (
        rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
        .select("_hot", F.ceil(F.col("_n") / least).cast("int").alias("_ways"))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, total: int, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, key, how)``, where ``right`` has few rows a key and ``left`` may have any number.

    Rows of a hot key of ``left`` are dealt by the hash of ``by`` to several tasks, and the key's rows of ``right`` are repeated for each. Tables of fewer
    than HOT_ROWS rows have no hot key.
    """
    if total < HOT_ROWS:
        return left.join(shuffled(right), key, how)
    hot = hot_keys(left, key, total) if hot is None else hot
    side = lambda: F.broadcast(hot)  # noqa: E731  # at most HOT_KEYS rows, see hot_keys
    ways = F.coalesce("_ways", F.lit(1))
    dealt = left.join(side(), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.pmod(F.xxhash64(by), ways).cast("int")).drop("_hot", "_ways")
    copies = right.join(side(), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_hot", "_ways")
    return dealt.join(shuffled(copies), [key, "_salt"], how).drop("_salt")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _filler(docs: DataFrame) -> str:
    """A name that no column has: a struct needs one field at least."""
    return "_" * (1 + max(map(len, docs.columns), default=0))


def packed(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(F.lit(0).alias(_filler(docs)), *(F.col(quoted(c)) for c in docs.columns)).alias(name)


def unpacked(rows: DataFrame, docs: DataFrame, more: dict[str, Column] | None = None, name: str = "row") -> DataFrame:
    """The columns of ``docs`` out of the struct, but for those that ``more`` replaces, and ``more``."""
    more = more or {}
    return rows.select(*(F.col(f"{name}.{quoted(c)}").alias(c) for c in docs.columns if c not in more), *(v.alias(k) for k, v in more.items()))


def extended(docs: DataFrame, inputs: list[str], results: str, work: Callable[..., tuple], drop: tuple = ()) -> DataFrame:
    """``docs`` without ``drop``, with the columns of ``results`` (DDL): ``work`` gets the lists of the ``inputs`` of a batch and returns a list for each result.

    All other columns pass through untouched, whatever their types and names; a column of ``docs`` that is named as a result is replaced by it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    fields = T.StructType.fromDDL(results).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    kept = docs.drop(*drop)
    place = {c: i for i, c in enumerate(kept.columns)}
    rows = docs.select(packed(kept), *(F.col(quoted(c)).alias(f"i{k}") for k, c in enumerate(inputs) if c in drop))
    extra = {c: k + 1 for k, c in enumerate(c for c in inputs if c in drop)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            found = work(*((batch.column(extra[c]) if c in extra else pc.struct_field(own, [place[c] + 1])).to_pylist() for c in inputs))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(v, type=k) for v, k in zip(found, kinds, strict=True))], names=["row", *(f"r{i}" for i in range(len(fields)))])

    made = rows.mapInArrow(run, T.StructType([rows.schema["row"], *(T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields))]))
    return unpacked(made, kept, {f.name: F.col(f"r{i}") for i, f in enumerate(fields)})
