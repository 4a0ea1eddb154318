"""Neighbourhood work on tiles of rasters.

A page is cut into tiles, bounded in both directions, that overlap by the reach of the work: one shuffle on (page, tile). Each
tile is then a small two-dimensional array, and a whole chain of neighbourhood steps runs on it at once. Tile size is
fixed, so a huge page becomes many groups, however high or wide it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 64
WIDE = 512
#: Pixels of a page that a task still holds at once.
PAGE_PIXELS = 1 << 20


def with_page(pixels: DataFrame, page: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels with the columns of their page. The hash is built on the page's side: pixels are often made from few bytes, and a planner that
    goes by those would send all of them to every task."""
    return pixels.join(page.hint("shuffle_hash"), "page_id", how)


def same_pixels(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pixels that two tables with one row per pixel both have, with the columns of both (names must differ but for the key).

    Laid over each other by one aggregation on the pixel instead of a join: tables already dealt by page do not move again, and neither is broadcast.
    """
    key = ["page_id", "y", "x"]
    mine, theirs = ([c for c in df.columns if c not in key] for df in (left, right))
    kinds = dict(left.dtypes) | dict(right.dtypes)

    def row(df, side):
        return df.select(*key, *[(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in [*mine, *theirs]], F.lit(side).alias("_sides"))

    laid = row(left, 1).unionAll(row(right, 2)).groupBy(*key).agg(
        *[F.max(c).alias(c) for c in [*mine, *theirs]], F.sum("_sides").alias("_sides"))
    return laid.filter("_sides = 3").drop("_sides")


def page_sizes(pixels: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, whole): whether a page has each of its pixels once and few enough of them."""
    most = PAGE_PIXELS if most is None else most
    w, h, n = F.max("width").cast("long"), F.max("height").cast("long"), F.count("*")
    place = F.col("y").cast("long") * F.col("width") + F.col("x")
    complete = (n == w * h) & (F.min("y") >= 0) & (F.min("x") >= 0) & (F.max("y") < h) & (F.max("x") < w) & (
        F.sum(place) * 2 == n * (n - 1)) & (F.min("width") == F.max("width"))
    for c in ("r", "g", "b"):
        complete = complete & (F.count(c) == n)
    return pixels.groupBy("page_id").agg(F.coalesce(complete & (n <= most), F.lit(False)).alias("_whole")).select(
        "page_id", (F.col("_whole") & F.col("page_id").isNotNull()).alias("whole"))


def page_array(rows: pa.Table, cols: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a whole page as whole numbers (line, column, channel), and the place of each row."""
    w, h = rows["width"][0].as_py(), rows["height"][0].as_py()
    place = rows["y"].to_numpy().astype(np.int64) * w + rows["x"].to_numpy()
    out = np.empty((h * w, len(cols)), np.int64)
    for i, c in enumerate(cols):
        out[place, i] = rows[c].to_numpy()
    return out.reshape(h, w, len(cols)), place


def with_channels(rows: pa.Table, cols: tuple[str, ...], page: np.ndarray, place: np.ndarray) -> pa.Table:
    """``rows`` with the columns of ``page_array`` put back."""
    flat = page.reshape(-1, len(cols))
    for i, c in enumerate(cols):
        at = rows.schema.get_field_index(c)
        rows = rows.set_column(at, c, pa.array(flat[place, i]).cast(rows.schema.field(at).type))
    return rows


def _seen_by(at: str, size: str, reach: int, step: int) -> Column:
    """Numbers of the tiles along one direction that see a pixel."""
    low = F.greatest(F.lit(0), F.floor((F.col(at) - reach) / step)).cast("int")
    high = F.floor(F.least(F.col(at) + reach, F.col(size) - 1) / step).cast("int")
    return F.explode(F.sequence(low, high))


def tile_map(
    pixels: DataFrame, inputs: list[str], outputs: str, reach: int, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
    keep: list[str] | None = None, band: int = BAND, wide: int = WIDE,
) -> DataFrame:
    """Adds ``outputs`` that ``work`` makes of the ``inputs`` as arrays (line, column).

    A tile sees ``reach`` pixels beyond its own on each side, or the page's edge where that comes first, so results
    near a tile's border equal those of the whole page.
    """
    keep = [c for c in pixels.columns if c not in ("page_id", "y", "x")] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    names = [o.strip().split(" ")[0] for o in outputs.split(",")]
    carried = [c for c in keep if c not in names]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["page_id", "y", "x", *carried]) + ", " + outputs
    cols = list(dict.fromkeys(["page_id", "y", "x", *inputs, *carried]))
    tiles = pixels.select(*cols, "width", _seen_by("y", "height", reach, band).alias("_band")) if "width" not in cols else pixels.select(
        *cols, _seen_by("y", "height", reach, band).alias("_band"))
    tiles = tiles.select(*cols, "_band", _seen_by("x", "width", reach, wide).alias("_col"))

    def run(rows: pa.Table) -> pa.Table:
        y, x = rows.column("y").to_numpy(), rows.column("x").to_numpy()
        top, left = y.min(), x.min()
        at = (y - top, x - left)
        shape = (int(at[0].max()) + 1, int(at[1].max()) + 1)
        arrays = {}
        for c in inputs:
            values = rows.column(c).to_numpy()
            grid = np.zeros(shape, values.dtype)
            grid[at] = values
            arrays[c] = grid
        made = work(arrays)
        first_y, first_x = rows.column("_band")[0].as_py() * band, rows.column("_col")[0].as_py() * wide
        own = (y >= first_y) & (y < first_y + band) & (x >= first_x) & (x < first_x + wide)
        out = rows.select(["page_id", "y", "x", *carried]).filter(pa.array(own))
        at = (at[0][own], at[1][own])
        for n in names:
            out = out.append_column(n, pa.array(made[n][at]))
        return out.cast(pa.schema([pa.field(n, types[n] if n in types else out.schema.field(n).type) for n in out.column_names]))

    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = _parse_datatype_string(outputs)
    types = {f.name: to_arrow_type(f.dataType) for f in wanted.fields}
    return tiles.groupBy("page_id", "_band", "_col").applyInArrow(run, schema)


# ---------------------------------------------------------------- steps on one band


def square_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over the (2r+1)² square clipped to the array."""
    for axis in (0, 1):
        n = a.shape[axis]
        run = np.concatenate([np.zeros_like(a.take([0], axis), dtype=np.float64), np.cumsum(a, axis=axis, dtype=np.float64)], axis)
        i = np.arange(n)
        a = run.take(np.minimum(i + r + 1, n), axis) - run.take(np.maximum(i - r, 0), axis)
    return a


def square_mean(a: np.ndarray, r: int) -> np.ndarray:
    return square_sum(a, r) / square_sum(np.ones(a.shape), r)


def dilated(m: np.ndarray, r: int) -> np.ndarray:
    return square_sum(m, r) > 0.5


def eroded(m: np.ndarray, r: int) -> np.ndarray:
    """Outside the page counts as empty."""
    return square_sum(m, r) > (2 * r + 1) ** 2 - 0.5


def ranked(a: np.ndarray, r: int, largest: bool) -> np.ndarray:
    """Maximum or minimum over the (2r+1)² square clipped to the array."""
    pick = np.maximum if largest else np.minimum
    for axis in (0, 1):
        best = a
        for d in range(1, r + 1):
            i = np.arange(a.shape[axis])
            best = pick(best, pick(a.take(np.minimum(i + d, a.shape[axis] - 1), axis), a.take(np.maximum(i - d, 0), axis)))
        a = best
    return a


def surroundings(a: np.ndarray) -> np.ndarray:
    """(9, line, column): the 3×3 values round each pixel; the edge repeats itself."""
    p = np.pad(a, 1, mode="edge")
    h, w = a.shape
    return np.stack([p[dy:dy + h, dx:dx + w] for dy in range(3) for dx in range(3)])
