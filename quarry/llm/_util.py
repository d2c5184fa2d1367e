"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """The folder, shared by driver and executors, for materialised tables.

    ``spark.checkpoint.dir`` names it. Only where that setting is missing in a
    session of one process, as in tests, is a temporary folder made and set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{workspace(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


#: Paths made within each open ``scratch``, the innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a read and no replay, and
    freezes whatever depends on the partition a row was in.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._quarry_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Within it, what is materialised is deleted at the end, but for the tables put into the list that it gives."""
    made, kept = [], []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.pop()
        spared = {t._quarry_path for t in kept}
        for path in made:
            if path not in spared:
                _delete(spark, path)
        if _scopes:
            _scopes[-1] += spared


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, out of the way of other names; ``unpacked`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


#: Rows of a table of a few numbers each that is sent to all tasks at most; a larger one is shuffled.
SENT_ROWS = 1_000_000


def sent_if_small(table: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """``table``, a materialised one, to be broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def finite_vector(vector: Column) -> Column:
    """True if the vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of every text; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20):
    """Within it, jobs that run send Python at most about ``size`` bytes at a time; for rows of megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def exchanges_freed(spark: SparkSession):
    """Within it, Spark deletes a job's shuffle files when the job ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches, rows: int = 256):
    """The batches in parts of few rows: texts become Python objects a part at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Lists of one length as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is far faster here than numpy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def row_count_and(df: DataFrame, *aggregates: Column):
    """One row of whole-table aggregates, as a Row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggregates).first()
