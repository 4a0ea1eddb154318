"""Pictures as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: a file that claims this resolution or less does not know its own
UNKNOWN_DPI = 96
PIXEL_SCHEMA = "label string, y int, x int, r int, g int, b int, a int, width int, height int"
ROWS_PER_BATCH = 65536


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(label, image struct, error) of every file below ``path``; the label is the file's stem.

    A file that is no picture stays with ``error`` set; it has no pixels.
    """
    loaded = spark.read.format("image").load(path)
    stem = F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[^.]*$", "")
    return loaded.select(stem.alias("label"), "image", F.when(~(F.col("image.height") > 0), "unreadable").alias("error"))


def _explode_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Raw BGR(A) or grey bytes to rows, a bounded number of pixels at a time."""
    for batch in batches:
        image = batch.column("image")
        sizes = zip(*(image.field(c).to_pylist() for c in ("height", "width", "nChannels")))
        for label, (h, w, n), data in zip(batch.column("label").to_pylist(), sizes, image.field("data")):
            if not h or h < 0:
                continue
            px = np.frombuffer(data.as_buffer(), np.uint8, count=h * w * n).reshape(h * w, n)
            for s in range(0, h * w, ROWS_PER_BATCH):
                part = px[s:s + ROWS_PER_BATCH].astype(np.int32)
                at = np.arange(s, s + len(part), dtype=np.int32)
                b, g, r = (part[:, 0],) * 3 if n == 1 else (part[:, 0], part[:, 1], part[:, 2])
                a = part[:, 3] if n == 4 else np.full(len(part), 255, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(part)), pa.array(at // w), pa.array(at % w), pa.array(r), pa.array(g), pa.array(b),
                     pa.array(a), pa.array(np.full(len(part), w, np.int32)), pa.array(np.full(len(part), h, np.int32))],
                    names=["label", "y", "x", "r", "g", "b", "a", "width", "height"])


def pixels_of(images: DataFrame, dpi: DataFrame | None = None) -> DataFrame:
    """Pixel rows of decoded pictures. ``dpi`` (label, dpi) joins a known resolution; 96 and less counts as unknown."""
    px = images.select("label", "image").mapInArrow(_explode_pixels, PIXEL_SCHEMA)
    if dpi is None:
        return px.withColumn("dpi", F.lit(None).cast("int"))
    known = dpi.select("label", F.when(F.col("dpi") > UNKNOWN_DPI, F.col("dpi")).alias("dpi"))
    return px.join(known, "label", "left")
