"""Bloom filters of a fixed size: a broadcast whose bound does not depend on the data.

A filter only saves work: a false hit costs a row that the following exact join drops, and nothing is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import over_batches

BITS = 1 << 23  # 1 MB


def build(hashes: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """The bits of a column of 64-bit hashes, or-ed together by Spark in 64-bit words; nulls are left out."""
    a = F.pmod(F.col(name), F.lit(bits))
    b = F.pmod(F.shiftright(F.col(name), 24), F.lit(bits))
    rows = (
        hashes.filter(F.col(name).isNotNull())
        .select(F.explode(F.array(a, b)).alias("at"))
        .groupBy((F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("set"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("set").to_numpy()
    return out


def holds(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    h = hashes.astype(np.uint64, copy=False).view(np.int64)
    mask = np.int64(len(filled) * 64 - 1)
    a, b = h & mask, (h >> np.int64(24)) & mask
    one = np.int64(1)
    return (((filled[a >> 6] >> (a & 63)) & (filled[b >> 6] >> (b & 63))) & one).astype(bool)


def parted(df: DataFrame, hashes: list, filled: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows with none of whose ``hashes`` in the filter, rows that may have one); rows stay where they are."""
    sent = df.sparkSession.sparkContext.broadcast(filled)
    names = [f"_hash{i}" for i in range(len(hashes))]
    named = df.withColumns(dict(zip(names, hashes)))

    def rows(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen = np.zeros(b.num_rows, bool)
                for c in b.columns[-len(names):]:
                    seen |= holds(sent.value, c.to_numpy())
                kept = b.columns[:-len(names)]
                yield pa.RecordBatch.from_arrays(kept, b.schema.names[:-len(names)]).filter(pa.array(seen == wanted))

        return over_batches(named, run, df.schema)

    return rows(False), rows(True)


def without(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``ids`` (one column of that name): an exact anti join that moves only rows the filter cannot clear."""
    clear, rest = parted(df, [F.xxhash64(on)], build(ids.select(F.xxhash64(on).alias("h")), "h"))
    return clear.unionByName(rest.join(ids, on, "left_anti").select(df.columns))
