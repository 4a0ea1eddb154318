"""The cleaning recipe on pages that a task holds as arrays.

The steps of ``corpus.clean_corpus`` one after another without rows in between: a page crosses to Python once. Pages that are too large, or whose
raster is incomplete, go through the operators on tiles and windows instead; results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import RGB
from ..operators import keying, raster, regions
from ..operators.tiles import page_array, ranked, with_channels


def clean_held(pixels: DataFrame, page: DataFrame, min_side: int, min_area: int, letter: int, dark: int, fill: bool, known: bool) -> DataFrame:
    """Keyed RGBA of whole pages. ``page`` has (page_id, cr, cg, cb, kind); ``known`` tells that kinds were given."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields) + ", a int"

    def run(rows: pa.Table, about: pa.Table) -> pa.Table:
        about = about.to_pylist()
        if not rows.num_rows or not about or any(about[0][f"c{c}"] is None for c in RGB):
            return rows.slice(0, 0).append_column("a", pa.array([], pa.int32()))
        scan, place = page_array(rows, RGB)
        carrier, kind = [about[0][f"c{c}"] for c in RGB], about[0]["kind"]
        alpha = _overridden(scan, _keyed(scan, carrier), carrier)
        if kind == "photo":
            alpha = _without_fringe(alpha)
        alpha = np.where(alpha < keying.MATTE_FLOOR, 0, alpha)
        for largest in (False, True, True, False):
            alpha = ranked(alpha, 1, largest)
        clean = raster.destriped_page(scan)
        if fill and sum(carrier) / 3.0 >= dark and (kind is not None or not known):
            hole = _white_ink(clean, alpha, carrier, kind, min_side, min_area, letter)
            clean[hole], alpha[hole] = 255, 255
        return with_channels(rows, RGB, clean, place).append_column("a", pa.array(alpha.ravel()[place].astype(np.int32)))

    # under a name of its own, for both may come of one table
    about = page.select(F.col("page_id").alias("_page"), "cr", "cg", "cb", "kind")
    return pixels.groupBy("page_id").cogroup(about.groupBy("_page")).applyInArrow(run, schema)


def _chroma(v: np.ndarray) -> np.ndarray:
    return v.max(-1) - v.min(-1)


def _neutral(carrier: list[int]) -> bool:
    return max(carrier) - min(carrier) < keying.NEUTRAL_SPREAD and sum(carrier) / 3.0 > keying.NEUTRAL_LEVEL


def _norm(v: list) -> np.ndarray:
    return np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def _keyed(scan: np.ndarray, carrier: list[int]) -> np.ndarray:
    """As ``keying.carrier_alpha``."""
    ch = [scan[..., i] for i in range(3)]
    dist = _norm([ch[i] - carrier[i] for i in range(3)])
    if _neutral(carrier):
        return np.where(dist < keying.TOL, 0, 255)
    light, grey = (ch[0] + ch[1] + ch[2]) / 3.0, sum(carrier) / 3.0
    tint_c, tint_p = [v - grey for v in carrier], [v - light for v in ch]
    along = tint_p[0] * tint_c[0] + tint_p[1] * tint_c[1] + tint_p[2] * tint_c[2]
    nc = float(_norm(tint_c)) or 1.0
    np_ = _norm(tint_p)
    share, off = along / (nc * nc), np.abs(tint_p[0]) + np.abs(tint_p[1]) + np.abs(tint_p[2])
    spots = keying.white_spots({
        "_share": share, "_heading": along / (np_ * nc + 1e-6), "_strength": np_ / nc, "_dark": light < keying.DARK,
        "_may": (nc >= keying.TINT_LEAST) & (light > grey - 12)})
    white = ((off < keying.WHITE_TINT) & (light > keying.WHITE_LEVEL)) | spots
    film = (share > keying.FILM_LOW) & (share < keying.FILM_HIGH) & (np.abs(light - grey) < keying.FILM_LIGHT)
    backing = ((dist < keying.TOL) | film) & ~white
    ramp = np.floor(np.clip((dist - keying.TOL) / max(1, keying.SOFT), 0.0, 1.0) * 255).astype(np.int64)
    return np.where(~backing, 255, np.where(dist < keying.TOL, 0, ramp))


def _overridden(scan: np.ndarray, alpha: np.ndarray, carrier: list[int]) -> np.ndarray:
    """As ``keying.alpha_overrides``."""
    spread, grey = _chroma(scan), sum(carrier) / 3.0
    faint = _neutral(carrier) & (scan.sum(-1) / 3.0 > keying.FAINT_LEVEL) & (spread < keying.KEEP_SPREAD)
    white = (scan.min(-1) > keying.KEEP_WHITE) & (spread < keying.KEEP_SPREAD) & (grey < keying.BRIGHT_BACKING)
    out = np.where(faint, 0, np.where(white, 255, alpha))
    (top, bottom), (left, right) = _flat_ends(scan), _flat_ends(scan.swapaxes(0, 1))
    h, w = alpha.shape
    out[:top], out[h - bottom:] = 0, 0
    out[:, :left], out[:, w - right:] = 0, 0
    return out


def _flat_ends(scan: np.ndarray) -> tuple[int, int]:
    """How many lines from the first and from the last on are one flat colour, see ``raster.edge_strips``."""
    off = np.abs(scan - np.median(scan, axis=1)[:, None]).max(-1)
    rough = np.flatnonzero((off <= raster.FLAT).mean(1) < raster.STRIP_SHARE)
    n, deep = len(scan), int(np.floor(raster.STRIP_DEPTH * max(scan.shape[:2]))) + 1
    first, last = (rough[0], n - 1 - rough[-1]) if len(rough) else (n, n)
    return int(min(first, deep, n)), int(min(last, deep, n))


class _Regions:
    """Regions of a mask: runs (y, x0, x1), the number ``of`` each run's region, and what the regions measure."""

    def __init__(self, mask: np.ndarray, diagonal: bool):
        h, w = mask.shape
        ends = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        self.shape = mask.shape
        (self.y, self.x0), self.x1 = np.nonzero(ends == 1), np.nonzero(ends == -1)[1]
        y, x0, x1 = self.y, self.x0, self.x1
        if not len(y):
            self.of = self.first = self.area = self.edge = y
            self.box = np.zeros((4, 0), np.int64)
            return
        root = regions.touching_roots(y, x0, x1, 1 if diagonal else 0)
        # runs come by line and column, so the smallest run of a region is its first
        self.first, self.of = np.unique(root, return_inverse=True)
        n, wide = len(self.first), x1 - x0
        self.area = self.sums(wide)
        self.edge = self.sums(wide * ((y == 0).astype(int) + (y == h - 1)) + (x0 == 0) + (x1 == w))
        self.box = np.stack([np.full(n, w), np.full(n, h), np.zeros(n, int), np.zeros(n, int)])
        for i, (pick, v) in enumerate(((np.minimum, x0), (np.minimum, y), (np.maximum, x1), (np.maximum, y + 1))):
            pick.at(self.box[i], self.of, v)

    def sums(self, per_run: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, per_run, len(self.first)).astype(np.int64)

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """The mask of the chosen regions."""
        mine = chosen[self.of]
        edges = np.zeros((self.shape[0], self.shape[1] + 1), np.int8)
        np.add.at(edges, (self.y[mine], self.x0[mine]), 1)
        np.add.at(edges, (self.y[mine], self.x1[mine]), -1)
        return edges.cumsum(1)[:, :-1] > 0


def _without_fringe(alpha: np.ndarray) -> np.ndarray:
    """As ``regions.fringe_among``, taken off."""
    (h, w), d = alpha.shape, regions.DOWN
    mask = np.pad(alpha > regions.OPAQUE, ((0, -h % d), (0, -w % d)))
    small = mask.reshape(mask.shape[0] // d, d, mask.shape[1] // d, d).any((1, 3))[:max(1, h // d), :max(1, w // d)]
    r = _Regions(small, True)
    wc, hc = r.box[2] - r.box[0], r.box[3] - r.box[1]
    longest, least = np.maximum(wc, hc), np.minimum(wc, hc)
    gone = (r.edge > 0) & (r.edge >= regions.FRINGE_HUG * longest) & (longest * d > regions.FRINGE_LONG * max(w, h)) & (
        (least * d < regions.FRINGE_THIN * min(w, h)) | (r.area / np.maximum(wc * hc, 1) < regions.FRINGE_FILL))
    if not gone.any():
        return alpha
    cells = r.covered(gone).repeat(d, 0).repeat(d, 1)[:h, :w]
    cells = np.pad(cells, ((0, h - cells.shape[0]), (0, w - cells.shape[1])))
    return np.where(cells, 0, alpha)


def _white_ink(clean: np.ndarray, alpha: np.ndarray, carrier: list[int], kind: str | None, min_side: int, min_area: int, letter: int) -> np.ndarray:
    """Where holes are to be filled, as ``regions.enclosed_holes`` tells."""
    r = _Regions(alpha <= regions.OPAQUE, False)
    shut = r.edge == 0
    if not shut.any():
        return np.zeros(alpha.shape, bool)
    w = alpha.shape[1]
    hw, hh = r.box[2] - r.box[0], r.box[3] - r.box[1]
    short, long_ = np.minimum(hw, hh), np.maximum(hw, hh)
    ink = _Regions(alpha > regions.OPAQUE, True)
    # the ink run that ends where the hole's topmost run begins encloses it
    ends, wanted = ink.y * (w + 1) + ink.x1, r.y[r.first] * (w + 1) + r.x0[r.first]
    at = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
    host = ink.of[at]
    piece = np.minimum(ink.box[2] - ink.box[0], ink.box[3] - ink.box[1])[host]
    counter = (ends[at] == wanted) & (piece <= letter) & (long_ <= 3 * short) & (long_ >= 0.25 * piece)
    film = np.zeros(len(short), bool)
    if not _neutral(carrier):
        tint = [c - sum(carrier) / 3.0 for c in carrier]
        n2 = tint[0] * tint[0] + tint[1] * tint[1] + tint[2] * tint[2]
        if n2 >= regions.FILM_TINT:
            upto = np.concatenate([np.zeros((len(clean), 1, 3), np.int64), clean.cumsum(1)], 1)
            sums = upto[r.y, r.x1] - upto[r.y, r.x0]
            avg = [r.sums(sums[:, i]) / r.area for i in range(3)]
            mean = (avg[0] + avg[1] + avg[2]) / 3.0
            film = ((avg[0] - mean) * tint[0] + (avg[1] - mean) * tint[1] + (avg[2] - mean) * tint[2]) / n2 >= regions.FILM_SHARE
    fill = ~((short < min_side) | (r.area < min_area)) & ~counter & ~film
    # digital art on white: whatever an outline shuts in is its white ink
    return r.covered(shut & (fill | (_neutral(carrier) and kind == "digital")))
