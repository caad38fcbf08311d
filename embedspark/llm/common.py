"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from embedspark.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_worker(name: str, make: Callable):
    """An object that lives as long as the Python worker, so that its tasks share what one has learnt."""
    store = sys.modules.setdefault("_embedspark_worker", types.ModuleType("_embedspark_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def frugal(function):
    """Makes an Arrow batch function give memory back to the system at its end, as idle workers live on."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values from 64-bit values (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from 64-bit values."""
    return ((x >> np.uint64(11)).astype("f8") + 0.5) * (1.0 / (1 << 53))


def long_list(values: list[np.ndarray], kind: str = "i8") -> pa.ListArray:
    """Integer arrays as an Arrow list column."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype("i4")
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def text_slices(batch: pa.RecordBatch, column: str, max_chars: int = 500_000):
    """Parts of a batch that hold about so many bytes of text, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > max_chars:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    if batch.num_rows > first:
        yield batch.slice(first)


def near_rows(rows: DataFrame, wanted: DataFrame, column: str, buckets: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be among the wanted values, and rows for which it surely is not.

    Compares hash buckets: the broadcast holds at most ``buckets`` numbers whatever the tables' size. It
    only spares the sure ones a shuffle; where buckets fill up, fewer rows are spared.
    """
    bucket = F.coalesce(F.pmod(F.xxhash64(column), F.lit(buckets)), F.lit(-1)).alias("_bucket")
    taken = F.broadcast(wanted.select(bucket).distinct())
    tagged = rows.withColumn("_bucket", bucket)
    near, far = (tagged.join(taken, "_bucket", how).drop("_bucket") for how in ("left_semi", "left_anti"))
    return near, far


def whole_groups(batches, column: str, rows_at_once: int = 8192):
    """Tables that hold whole groups of neighbouring rows with the same value of ``column``."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows_at_once:
            continue
        table_ = pa.Table.from_batches(held).combine_chunks()
        value = np.asarray(table_.column(column).combine_chunks())
        cut = int(np.flatnonzero(value != value[-1]).max(initial=-1)) + 1
        if cut:
            yield table_.slice(0, cut)
            held = table_.slice(cut).combine_chunks().to_batches()
            count = table_.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_recorders: list[list[str]] = []


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The table written to the shared folder and read back: a lost executor then repeats little."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(folder)
    for folders in _recorders:
        folders.append(folder)
    table_ = spark.read.parquet(folder)
    table_.folder = folder
    return table_


@contextmanager
def recording(folders: list[str] | None = None):
    """Notes the folders of all tables written inside."""
    folders = [] if folders is None else folders
    _recorders.append(folders)
    try:
        yield folders
    finally:
        del _recorders[next(i for i, own in enumerate(_recorders) if own is folders)]


def discard(spark: SparkSession, folders: list[str], keep: tuple = ()) -> None:
    """Deletes written tables that nothing will read any more."""
    kept = {df.folder for df in keep}
    for folder in [f for f in folders if f not in kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        folders.remove(folder)
