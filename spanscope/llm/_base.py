"""Helpers shared by the corpus operators: columns, scratch space, Arrow."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name and cast them, whatever else the table holds.

    Columns are addressed by position, so extra columns whose names differ in
    case only, or repeat a name, cannot make the reference ambiguous; of equal
    names the first counts.
    """
    small_batches(df.sparkSession)
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    missing = [n for n in wanted if n not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in {names}")
    return flat.select(*[F.col(f"_{names.index(n)}").cast(t).alias(n) for n, t in wanted.items()])


def flat(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns renamed by position, and the new name of each old one (the first of equal names)."""
    small_batches(df.sparkSession)
    new = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*new), {n: f"_{i}" for i, n in reversed(list(enumerate(df.columns)))}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spanscope-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows and 8 MB, unless the session says otherwise.

    By default a batch takes 10,000 rows whatever their size, and documents are
    large: batches then take hundreds of megabytes beside the heap.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if spark.conf.get(key, None) is None:  # not set by the session
            spark.conf.set(key, str(value))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession):
    """Shuffle files of queries that run meanwhile go when these end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write a compressed table to the shared folder and read it back.

    The shuffle files of the query that wrote it go when it ends: what comes
    after reads the table, and a loop of many steps would fill executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, *, dealt: bool = False):
    """The frame, written as ``stored`` does but in buckets of ``key``: joins by it shuffle their other side only.

    A table of the session while the block runs; its files stay.  A frame that
    comes from such a join is ``dealt`` by the key already.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name = f"t_{uuid.uuid4().hex}"
    with _freed(spark):
        (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(o) or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    _, off = text_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def tidy(run):
    """A function over batches that hands freed memory back when it ends, for the worker lives on."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return wrapped
