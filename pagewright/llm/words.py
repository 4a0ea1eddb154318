"""Words of whole texts as arrays: spans and 64-bit hashes, straight from Arrow buffers.

No Python object is made per word. Texts are worked through in blocks of about 256 KB (a longer text is a
block of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_M1, _M2, _GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and every other byte to itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+`` in UTF-8."""
    t = np.ones(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def letters_and_digits() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower-cased UTF-8."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def text_blocks(column: pa.Array, block: int = BLOCK_BYTES):
    """(first row, bytes, bounds) per block of a binary or string column; null counts as empty.

    ``bounds`` has one entry more than the block has texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    kind = np.int64 if column.type == pa.large_binary() else np.int32
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + block, side="right")) - 1)
        yield row, data[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def spans(low: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of a block."""
    inside = table[low]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    start[first], end[last] = inside[first], inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(bounds, s, side="right") - 1


class SpanHash:
    """64-bit hashes of byte spans, from prefix sums of a polynomial; equal bytes hash alike in any text."""

    def __init__(self, seed: int = 1):
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(seed))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, BLOCK_BYTES + 1)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, low: np.ndarray) -> np.ndarray:
        self._reach(len(low))
        out = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(self.values[low] * self.power[:len(low)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64) * np.uint64(_GOLD))


def grams(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` consecutive words of one text, and the number of the first word of each."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(words) - k + 1
    h = mix(words[:last] + np.uint64(k))
    for j in range(1, k):
        h = mix(h * np.uint64(_GOLD) + words[j:last + j])
    at = np.flatnonzero(text[:last] == text[k - 1:])
    return h[at], at
