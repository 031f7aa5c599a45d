"""Shared plumbing of the training-data operators.

Materialised tables go to the shared folder that the session names in
``spark.checkpoint.dir``; only where that is unset on one machine (tests,
notebooks) a temporary folder is set.  Text columns travel as Arrow batches, and every
helper turns a null text into empty bytes.  Python workers outlive their tasks, so
what a task has freed goes back to the system at its end (``lean``).
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.session import scratch_folder

_SLICE = 256


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    target, fs = _hadoop_path(spark, path)
    fs.delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session is gone at interpreter exit
        pass


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per session."""
    if getattr(spark, "_basalt_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="basalt-ship-"), "basalt_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(target)
    spark._basalt_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wanted(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: extra columns can't clash with those an operator adds."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()))


def column_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty, a few at a time."""
    col = batch.column(batch.schema.get_field_index(name))
    for i in range(0, len(col), _SLICE):
        for x in col.slice(i, _SLICE).cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist():
            yield x or b""


def column_texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    """The values of a string column, null as empty, a few at a time."""
    col = batch.column(batch.schema.get_field_index(name))
    for i in range(0, len(col), _SLICE):
        for x in col.slice(i, _SLICE).to_pylist():
            yield x or ""


def few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that what is made of them is sent on before the next."""
    for i in range(0, batch.num_rows, _SLICE):
        yield batch.slice(i, _SLICE)


def give_back() -> None:
    """Returns freed memory to the system, which the allocators of Arrow and of the C library (glibc) else keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at the end of a task its worker gives memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def taken(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(column: str = "text") -> Column:
    """Tells rows of one id apart: equal id and equal text are the same row to every operator here."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))
