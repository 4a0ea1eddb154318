"""Small rasters for tests."""

import struct
import zlib

import numpy as np
import pandas as pd


def pixel_table(spark, pages: dict[int, np.ndarray]):
    """RGB or RGBA arrays as the pixel table."""
    parts = []
    for page, a in pages.items():
        h, w, n = a.shape
        y, x = np.indices((h, w)).reshape(2, -1).astype("int32")
        v = a.reshape(-1, n).astype("int32")
        alpha = v[:, 3] if n == 4 else np.full(h * w, 255, "int32")
        parts.append(pd.DataFrame({"page_id": np.int64(page), "y": y, "x": x, "r": v[:, 0], "g": v[:, 1], "b": v[:, 2], "a": alpha,
                                   "width": np.int32(w), "height": np.int32(h)}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def grid(rows, col, shape):
    out = np.zeros(shape, dtype=type(rows[0][col]))
    for r in rows:
        out[r["y"], r["x"]] = r[col]
    return out


def png(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    raw = b"".join(b"\0" + a[i].astype(np.uint8).tobytes() for i in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
