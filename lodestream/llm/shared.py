"""What the operators share: tables in the cluster's shared folder, and Arrow batches cut by bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestream.session import scratch, ship

#: Rows of an Arrow batch that goes to a Python worker; long texts make a batch large, so it is kept low.
ARROW_ROWS = 500
#: Bytes of a row group of a stored table; a writer holds one in memory.
ROW_GROUP_BYTES = 8 << 20
#: Bytes of text that a worker treats at once; numpy needs a few dozen bytes for each of them.
SLICE_BYTES = 1 << 20


#: Folders of this process's stored() tables, which go when it ends.
_made: dict[str, SparkSession] = {}


@atexit.register
def _discard_all() -> None:
    for path, spark in _made.items():
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the session may be ending too
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = scratch(spark)
    _made[path] = spark
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Files of shuffles whose plans nobody holds any more go now, not when the driver next happens to collect its garbage. The listeners' last event holds the plan that it tells of, so another query's comes after it."""
    gc.collect()
    spark.range(1).collect()
    with contextlib.suppress(Exception):  # slow listeners are not waited for
        spark._jsc.sc().listenerBus().waitUntilEmpty(5000)
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def small_batches(spark: SparkSession) -> None:
    """Readies the session for Python operators: the workers get the package, and Arrow batches are kept small; results don't depend on it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: What the operator that runs in this worker keeps between tasks.
_worker: dict = {}


def begin(owner: str) -> None:
    """Called by an operator's function in a worker: what another operator kept goes, and freed memory returns to the system."""
    if _worker.get("owner") != owner:
        _worker.clear()
        _worker["owner"] = owner
        gc.collect()
        release()


def release() -> None:
    """Returns what the worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """A value that an operator makes once for a worker, until another operator begins there."""
    begin(owner)
    if key not in _worker:
        _worker[key] = make()
    return _worker[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy where there are no nulls; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, owner: str = "texts") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds one row or at most ``limit`` bytes of the column; owner is that of what the worker is to keep."""
    begin(owner)
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
