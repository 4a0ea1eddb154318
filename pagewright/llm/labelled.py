"""Learning from labelled documents: folds, bounded samples and scoring of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, over_batches
from .words import text_blocks


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.ChunkedArray, np.ndarray]:
    """(texts, labels) of at most ``most`` labelled rows outside the held-out fold, the first in the order of a hash of the id.

    The bound is on ids, and an id gives one row: of repeated ones, that whose text has the smallest hash. A label that is null or that
    contradicts another of the same id is left out. The ids are chosen before any text is read.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y IS NOT NULL AND _id IS NOT NULL")
        .filter(~held_out("_id")).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").select("_id", "_y")
    )
    docs = documents.select(F.col(id_col).alias("_id"), as_bytes(text_col, "text"))
    ids = known.join(docs.select("_id"), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toArrow()
    order = rows.column("_id").combine_chunks().to_numpy(zero_copy_only=False).argsort(kind="stable")
    rows = rows.take(pa.array(order))
    return rows.column("text"), rows.column("_y").to_numpy().astype(np.float64)


def scored(documents: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row; ``make()`` gives, once per task, the function from a block of texts to scores."""
    docs = documents.select(F.col(id_col).alias("doc_id"), as_bytes(text_col, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            for row, data, bounds in text_blocks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(bounds) - 1), pa.array(score(data, bounds))], ["doc_id", "score"])

    return over_batches(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def kept(documents: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], keep: Callable[[np.ndarray], np.ndarray],
         text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose score ``keep`` accepts, all columns as they are; rows are judged where they lie, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            ok = [keep(score(data, bounds)) for _, data, bounds in text_blocks(b.column(b.schema.names.index(text_col)))]
            yield b.filter(pa.array(np.concatenate(ok) if ok else np.zeros(0, bool)))

    return over_batches(documents, run, documents.schema)
