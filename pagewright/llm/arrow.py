"""Running numpy code on batches of a DataFrame."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as in rows, so that very long texts do not pile up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def as_bytes(name: str, alias: str):
    """A text column in UTF-8; null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary")).alias(alias)


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the size of each list."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column from flat bytes and the size of each value."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])
    return whole.cast(pa.binary())
