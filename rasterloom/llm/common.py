"""Helpers that the training-data operators share: table access, shared scratch tables, batch slicing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are taken in slices of about so many bytes, so that numpy's intermediate arrays stay small.
SLICE_BYTES = 1 << 19
#: Spark sends Arrow batches of about so many bytes to Python, however long the rows are.
BATCH_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (the folder may be in a store that only Spark reads)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session's owner has set a bound."""
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and Spark runs in one process (tests) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = getattr(shared_dir, "own", None)
    if found is None:
        found = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='rasterloom-')}"
    return found


#: Where the scratch paths that a recorded() block asks for are listed.
_paths: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("paths", default=None)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the scratch paths that this thread asks for within the block; who knows when they are done can remove() them."""
    token = _paths.set(paths := [])
    try:
        yield paths
    finally:
        _paths.reset(token)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if (paths := _paths.get()) is not None:
        paths.append(path)
    return path


#: Spark removes a query's shuffle files when it has ended, instead of when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts lineage, survives lost executors."""
    small_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path := scratch_path(spark, what))
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(table: DataFrame) -> None:
    """Removes a table that stored() made, once nothing reads it any more."""
    remove(table.sparkSession, table._scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving its memory back to the system when a task ends: workers stay, beside whatever runs next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        tidy()

    return run


def tidy() -> None:
    """Gives memory that this process doesn't use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: A key that more than one in so many rows have is hot; there are fewer than so many of them, whatever the input.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """rows (inner) joined with facts, which has one row for each key and in column n how many of `total` rows have it
    (None: the sum of n, so that fewer than HOT_SHARE keys can be hot).

    Hot keys' facts, fewer than HOT_SHARE of them, are broadcast, so their rows stay where they are; the others are
    shuffled and no task gets more than its share. facts must be stored: they are read twice. n is dropped.
    """
    from pyspark.sql import functions as F

    if total is None:
        total = facts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = total // HOT_SHARE
    hot, calm = facts.where(F.col(n) > least).drop(n), facts.where(F.col(n) <= least).drop(n)
    marks = hot.select(*keys)
    rest = rows.join(F.broadcast(marks), keys, "left_anti").join(calm.hint("shuffle_hash"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column holds about `most` bytes each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    at = batch.schema.get_field_index(column)
    ends = np.cumsum(lengths(batch.column(at)))
    start = 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes as one array, and the n + 1 offsets in it (null: empty)."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()) if pa.types.is_large_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary()), b"")
    ends = np.cumsum(lengths(column))
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    buffers = column.buffers()
    first = np.frombuffer(buffers[1], np.int64)[column.offset]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[first : first + offsets[-1]], offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
