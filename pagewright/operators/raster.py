"""Statistics and neighbourhoods of page rasters.

Pixels are rows ``(page_id, y, x, r, g, b[, a], width, height)``; the page size rides along (it costs nothing in
a columnar file), so no operator has to join pixels with a page table. Neighbourhoods are windows over one
row or one column of a page, which splits even a huge page into many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import RGB, grey
from ..session import cut, is_empty
from .tiles import dilated, eroded, page_array, page_sizes, ranked, surroundings, tile_map, with_channels, with_page

# fixed values: border share and backdrop rules
BORDER = 0.06
FLAT = 6
BACKDROP_SHARE = 0.35
SHEET_SHARE = 0.02
STRIP_SHARE = 0.98
STRIP_DEPTH = 0.1
# fixed values: dark fills a clear background can get
KEY_COLOURS = ((0, 0, 0), (0, 0, 110), (0, 90, 0), (90, 0, 90), (70, 45, 0), (0, 70, 70))
# fixed values: streak detection
STREAK_WINDOW = 25
STREAK_Z = 5.0
STREAK_WIDTH = 3
MAD_SCALE = 1.4826
# fixed values: what counts as backdrop when light is measured, as ink and as an edge when grain is
BACKDROP_REACH = 52
LIT_SHARE = 0.05
GRAIN_INK = 60
GRAIN_EDGE = 40
GRAIN_NEEDED = 500
# fixed values: palettes
PALETTE_SIZE = 16
PALETTE_MERGE = 40
PALETTE_SHARE = 0.01
TRIM_ALPHA, TRIM_PAD = 12, 8
# boxes that still ride with their page
FEW_BOXES = 32
SOLID_INK = 200



def along_row():
    return Window.partitionBy("page_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("page_id", "x").orderBy("y")


# ---------------------------------------------------------------- borders and histograms


def border_width() -> Column:
    return F.greatest(F.lit(2), F.floor(F.least("width", "height") * BORDER).cast("int"))


def _border_times() -> Column:
    """How often a pixel lies in the four border bands: corners count twice."""
    bw = border_width()
    bands = (F.col("y") < bw, F.col("y") >= F.col("height") - bw, F.col("x") < bw, F.col("x") >= F.col("width") - bw)
    total = F.lit(0)
    for band in bands:
        total = total + band.cast("int")
    return total


def border_colours(pixels: DataFrame) -> DataFrame:
    """(page_id, r, g, b, n): colours of the border with their multiplicity. Few rows per page."""
    times = _border_times()
    return pixels.filter(times > 0).groupBy("page_id", *RGB).agg(F.sum(times).alias("n"))


def border_median(pixels: DataFrame) -> DataFrame:
    """The backdrop: per-channel median of the border frame, cut to whole numbers."""
    c = border_colours(pixels)
    return c.groupBy("page_id").agg(*[F.percentile(ch, 0.5, F.col("n")).cast("int").alias(ch) for ch in RGB])


def backdrop_mode(pixels: DataFrame) -> DataFrame:
    """A digital backdrop: the commonest border colour (in steps of 8), when 35 % of the border is within 6 of it."""
    c = border_colours(pixels).withColumn("bin", F.struct(*[F.floor(F.col(ch) / 8).alias(ch) for ch in RGB]))
    bins = c.groupBy("page_id", "bin").agg(
        F.sum("n").alias("k"), *[(F.sum(F.col(ch) * F.col("n")) / F.sum("n")).alias(f"m{ch}") for ch in RGB])
    # most frequent; on a tie the lowest bin
    best = bins.groupBy("page_id").agg(F.min(F.struct(
        (-F.col("k")).alias("k"), F.col("bin"), *[F.col(f"m{ch}") for ch in RGB])).alias("t"))
    off = F.greatest(*[F.abs(F.col(ch) - F.col(f"t.m{ch}")) for ch in RGB])
    share = c.join(best, "page_id").groupBy("page_id").agg(
        (F.sum(F.when(off <= FLAT, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.first("t").alias("t"))
    flat = F.col("share") >= BACKDROP_SHARE
    return share.select("page_id", "share", *[F.when(flat, F.bround(f"t.m{ch}").cast("int")).alias(ch) for ch in RGB])


def sheet_mode(pixels: DataFrame) -> DataFrame:
    """The brightest colour bin (steps of 16) that covers at least 2 % of a page; null when none does."""
    bins = pixels.groupBy("page_id", *[F.floor(F.col(ch) / 16).cast("int").alias(ch) for ch in RGB]).agg(F.count("*").alias("n"))
    total = bins.groupBy("page_id").agg(F.sum("n").alias("total"))
    light = F.col("r") + F.col("g") + F.col("b")
    big = F.when(F.col("n") / F.col("total") >= SHEET_SHARE, F.struct(
        (-light).alias("light"), *[F.col(ch) for ch in RGB]))
    best = bins.join(total, "page_id").groupBy("page_id").agg(F.min(big).alias("t"))
    return best.select("page_id", *[(F.col(f"t.{ch}") * 16 + 8).alias(ch) for ch in RGB])


def key_colour_pick(pixels: DataFrame) -> DataFrame:
    """Of six dark fills, the one whose first-percentile distance to the art is the largest."""
    ink = pixels.filter(F.col("a") > SOLID_INK).groupBy("page_id", *RGB).agg(F.count("*").alias("n"))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(c) for c, v in zip(RGB, k)]) for i, k in enumerate(KEY_COLOURS)])
    d = ink.withColumn("k", F.explode(keys)).withColumn(
        "d", sum((F.abs(F.col(c) - F.col(f"k.{c}")) for c in RGB), F.lit(0)))
    far = d.groupBy("page_id", "k").agg(F.percentile("d", 0.01, F.col("n")).alias("far"))
    best = far.groupBy("page_id").agg(F.max(F.struct("far", (-F.col("k.i")).alias("i"), "k")).alias("t"))
    return best.select("page_id", *[F.col(f"t.k.{c}").alias(c) for c in RGB], F.col("t.far").alias("distance"))


# ---------------------------------------------------------------- neighbourhoods


def _line_sums(df: DataFrame, cols: dict[str, str], r: int, along) -> DataFrame:
    """Sums over ``2r+1`` neighbours along a line, clipped at its ends, from differences of running sums."""
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = df.withColumns({f"_u_{c}": F.sum(c).over(upto) for c in cols}).withColumns({f"_w_{c}": F.sum(c).over(whole) for c in cols})
    out = {
        name: F.coalesce(F.lead(f"_u_{c}", r).over(along), F.col(f"_w_{c}")) - F.coalesce(F.lag(f"_u_{c}", r + 1).over(along), F.lit(0))
        for c, name in cols.items()}
    return w.withColumns(out).drop(*[f"_{k}_{c}" for k in "uw" for c in cols])


def box_means(pixels: DataFrame, cols: dict[str, str], r: int) -> DataFrame:
    """Means of several columns over the (2r+1)² square clipped to the page, of complete pages.

    Sums along the line, then of those down the column: pixels dealt by page are sorted twice where they lie, and none goes through Python.
    """
    kinds = dict(pixels.dtypes)

    def near(along):
        return along.rangeBetween(-r, r)

    def seen(at, size):
        return F.least(F.col(at) + r, F.col(size) - 1) - F.greatest(F.col(at) - r, F.lit(0)) + 1

    across = {f"_b_{c}": F.sum(F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).over(near(along_row())) for c in cols}
    n = seen("x", "width") * seen("y", "height")
    square = {name: F.sum(f"_b_{c}").over(near(along_column())) / n for c, name in cols.items()}
    return pixels.withColumns(across).withColumns(square).drop(*across)


def box_mean(pixels: DataFrame, src: str, r: int, out: str) -> DataFrame:
    return box_means(pixels, {src: out}, r)


def mask_morph(pixels: DataFrame, mask: str, r: int, steps: dict[str, str]) -> DataFrame:
    """Boolean columns made of a mask by a (2r+1) square: ``steps`` maps a new column to dilate, erode or open.

    Outside the page counts as empty. However many are asked for, the pixels move once.
    """
    def work(a):
        thin = eroded(a[mask], r)
        made = {"dilate": lambda: dilated(a[mask], r), "erode": lambda: thin, "open": lambda: dilated(thin, r)}
        return {name: made[how]() for name, how in steps.items()}

    return tile_map(pixels, [mask], ", ".join(f"{name} boolean" for name in steps), 2 * r, work)


def square_rank(pixels: DataFrame, src: str, r: int, steps: str, out: str) -> DataFrame:
    """Grey minima and maxima over clipped squares one after another, a letter of ``steps`` each (``m`` or ``M``)."""
    def work(a):
        v = a[src]
        for s in steps:
            v = ranked(v, r, s == "M")
        return {out: v}

    kind = dict(pixels.dtypes)[src]
    return tile_map(pixels, [src], f"{out} {kind}", r * len(steps), work)


def trim_box(pixels: DataFrame, pad: int = TRIM_PAD) -> DataFrame:
    """Box of what is not clear, plus ``pad`` px, within the page; null for a clear page."""
    ink = F.col("a") > TRIM_ALPHA
    x, y = F.when(ink, F.col("x")), F.when(ink, F.col("y"))
    b = pixels.groupBy("page_id").agg(
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"),
        F.max("width").alias("width"), F.max("height").alias("height"))

    def low(c):
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.col(c) - pad)).alias(c)

    def high(c, size):
        return F.when(F.col(c).isNotNull(), F.least(F.col(size), F.col(c) + 1 + pad)).alias(c)

    return b.select("page_id", low("x0"), low("y0"), high("x1", "width"), high("y1", "height"))


# ---------------------------------------------------------------- quality measures


def sharpness_blockiness(pixels: DataFrame, carrier: DataFrame) -> DataFrame:
    """Per page: variance of the 4-neighbour Laplacian, 8-px block energy against all, spread of light on the backdrop.

    ``carrier`` has (page_id, cr, cg, cb).
    """
    g = pixels.withColumn("v", grey()).select("page_id", "y", "x", "width", "height", "v", *RGB)
    g = g.withColumn("left", F.lag("v").over(along_row())).withColumn("right", F.lead("v").over(along_row()))
    g = g.withColumn("up", F.lag("v").over(along_column())).withColumn("down", F.lead("v").over(along_column()))
    lap = F.col("left") + F.col("right") + F.col("up") + F.col("down") - 4 * F.col("v")
    step = F.abs(F.col("right") - F.col("v"))
    dist = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in RGB), F.lit(0)))
    bg = dist < BACKDROP_REACH
    m = with_page(g, carrier).groupBy("page_id").agg(
        F.var_pop(lap).alias("sharpness"),
        F.avg(F.when(F.col("x") % 8 == 7, step)).alias("_at"), F.avg(step).alias("_all"), F.max("width").alias("_w"),
        F.avg(bg.cast("int")).alias("_bg"), F.stddev_pop(F.when(bg, F.col("v"))).alias("_std"))
    block = F.when(F.col("_w") < 17, 1.0).otherwise(F.col("_at") / F.greatest(F.lit(1e-6), F.col("_all")))
    return m.select("page_id", "sharpness", block.alias("blockiness"),
                    F.when(F.col("_bg") > LIT_SHARE, F.col("_std")).otherwise(0.0).alias("light_std"))


def ink_grain(pixels: DataFrame, backdrop: DataFrame) -> DataFrame:
    """Mean distance of flat ink to its 3×3 median, away from edges; 0 under 500 such pixels."""
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"c{c}")) for c in RGB])
    # the backdrop meets pixels while they still lie with their page; behind the tiles they would all be shuffled for it
    p = with_page(pixels, backdrop).select("page_id", "y", "x", "width", "height", grey().alias("v"), (off > GRAIN_INK).alias("inked"))

    def work(a):
        v = a["v"].astype(np.int64)
        near = surroundings(v)
        line, col = np.indices(v.shape)
        rim = (col == 0) | (col == v.shape[1] - 1) | (line + a["y"].min() == 0) | (line + a["y"].min() == a["height"].max() - 1)
        edge = np.where(rim, v, np.clip(9 * v - near.sum(0), 0, None)) > GRAIN_EDGE
        return {"median": np.sort(near, 0)[4].astype(np.int32), "near_edge": dilated(edge, 2)}

    p = tile_map(p, ["v", "y", "height"], "median int, near_edge boolean", 3, work, keep=["v", "inked"])
    flat = F.col("inked") & ~F.col("near_edge")
    m = p.groupBy("page_id").agg(
        F.count_if(flat).alias("flat_pixels"), F.avg(F.when(flat, F.abs(F.col("v") - F.col("median")))).alias("_g"))
    return m.select("page_id", "flat_pixels", F.when(F.col("flat_pixels") < GRAIN_NEEDED, 0.0).otherwise(F.col("_g")).alias("grain"))


def edge_strips(pixels: DataFrame) -> DataFrame:
    """(page_id, top, bottom, left, right): how many lines from each edge inward are one flat colour."""
    def flat_lines(line):
        by = Window.partitionBy("page_id", line)
        m = pixels.select("page_id", line, *RGB, "width", "height", *[F.median(c).over(by).alias(f"m{c}") for c in RGB])
        off = F.greatest(*[F.abs(F.col(c) - F.col(f"m{c}")) for c in RGB])
        rough = F.avg((off <= FLAT).cast("int")) < STRIP_SHARE
        lines = m.groupBy("page_id", line).agg(rough.alias("rough"), F.max("width").alias("width"), F.max("height").alias("height"))
        size = F.max("height" if line == "y" else "width")
        deep = (F.floor(STRIP_DEPTH * F.greatest(F.max("width"), F.max("height"))) + 1)
        at = F.when(F.col("rough"), F.col(line))
        first = F.least(F.coalesce(F.min(at), size), deep, size).cast("int")
        last = F.least(size - 1 - F.coalesce(F.max(at), F.lit(-1)), deep, size).cast("int")
        names = ("top", "bottom") if line == "y" else ("left", "right")
        return lines.groupBy("page_id").agg(first.alias(names[0]), last.alias(names[1]))

    return flat_lines("y").join(flat_lines("x"), "page_id")


def in_strips() -> Column:
    """Whether a pixel joined with its page's strips lies in one."""
    return (
        (F.col("y") < F.col("top")) | (F.col("y") >= F.col("height") - F.col("bottom"))
        | (F.col("x") < F.col("left")) | (F.col("x") >= F.col("width") - F.col("right")))


def streak_columns(pixels: DataFrame) -> DataFrame:
    """(page_id, x, z): see ``_streaks``."""
    return _streaks(pixels).drop("width")


def _streaks(pixels: DataFrame) -> DataFrame:
    """(page_id, x, z, width): columns that are thin full-height scanner streaks.

    A column counts when its median offset from a 25-px moving mean stands out (robust z over 5), in runs of at
    most 3 px, and on pages where no more than an eighth of the columns would go.
    """
    r = STREAK_WINDOW // 2
    df = pixels.select("page_id", "y", "x", "width", *RGB)
    whole = along_row().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(0), F.lit(r) - F.col("x"))
    after = F.greatest(F.lit(0), F.col("x") + r - F.col("width") + 1)
    df = _line_sums(df, {c: f"s{c}" for c in RGB}, r, along_row())
    for c in RGB:
        padded = F.col(f"s{c}") + before * F.first(c).over(whole) + after * F.last(c).over(whole)
        df = df.withColumn(f"o{c}", F.col(c) - padded / float(STREAK_WINDOW))
    cols = df.groupBy("page_id", "x", "width").agg(*[F.median(f"o{c}").alias(f"o{c}") for c in RGB])
    mag = cols.select("page_id", "x", "width", sum((F.abs(F.col(f"o{c}")) for c in RGB), F.lit(0.0)).alias("mag"))
    page = Window.partitionBy("page_id")
    z = mag.withColumn("med", F.median("mag").over(page)).withColumn("dev", F.abs(F.col("mag") - F.col("med")))
    z = z.withColumn("z", F.col("dev") * F.signum(F.col("mag") - F.col("med")) / (MAD_SCALE * (F.median("dev").over(page) + 1e-3)))
    hot = z.filter(F.col("z") > STREAK_Z).withColumn(
        "island", F.col("x") - F.row_number().over(Window.partitionBy("page_id").orderBy("x")))
    thin = hot.withColumn("run", F.count("*").over(Window.partitionBy("page_id", "island"))).filter(F.col("run") <= STREAK_WIDTH)
    return thin.withColumn("all", F.count("*").over(page)).filter(F.expr("all <= width div 8")).select("page_id", "x", "z", "width")


def destripe(pixels: DataFrame) -> DataFrame:
    """Pixels with streak columns filled from the nearest clean column on each side; all others untouched.

    Pages a task can hold are mended in one pass, larger ones and incomplete rasters by windows.
    """
    if "height" not in pixels.columns:
        return destripe_by_windows(pixels)
    sizes = cut(page_sizes(pixels))
    whole = sizes.filter("whole").select("page_id")

    def mend(rows: pa.Table) -> pa.Table:
        scan, place = page_array(rows, RGB)
        return with_channels(rows, RGB, destriped_page(scan), place)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields)
    out = with_page(pixels, whole, "left_semi").groupBy("page_id").applyInArrow(mend, schema)
    return out if is_empty(sizes.filter("NOT whole")) else out.unionByName(destripe_by_windows(with_page(pixels, whole, "left_anti")))


def _streaks_of_page(scan: np.ndarray) -> np.ndarray:
    """Columns that are thin full-height streaks, see ``streak_columns``."""
    r, w = STREAK_WINDOW // 2, scan.shape[1]
    x = np.arange(w)
    upto = np.concatenate([np.zeros_like(scan[:, :1]), scan.cumsum(1)], 1)
    near = upto[:, np.minimum(x + r + 1, w)] - upto[:, np.maximum(x - r, 0)]
    padded = near + np.maximum(0, r - x)[:, None] * scan[:, :1] + np.maximum(0, x + r - w + 1)[:, None] * scan[:, -1:]
    mag = np.abs(np.median(scan - padded / float(STREAK_WINDOW), axis=0))
    mag = mag[:, 0] + mag[:, 1] + mag[:, 2]
    over = mag - np.median(mag)
    z = np.abs(over) * np.sign(over) / (MAD_SCALE * (np.median(np.abs(over)) + 1e-3))
    hot = np.flatnonzero(z > STREAK_Z)
    island = hot - np.arange(len(hot))
    thin = hot[np.isin(island, [i for i, n in zip(*np.unique(island, return_counts=True)) if n <= STREAK_WIDTH])]
    return thin if len(thin) <= w // 8 else thin[:0]


def destriped_page(scan: np.ndarray) -> np.ndarray:
    """``destripe`` of a page held as an array (line, column, channel)."""
    out, hot = scan.copy(), set(_streaks_of_page(scan).tolist())
    for x in hot:
        near = range(1, STREAK_WIDTH + 1)
        left = next((x - d for d in near if x - d >= 0 and x - d not in hot), None)
        right = next((x + d for d in near if x + d < scan.shape[1] and x + d not in hot), None)
        if left is not None or right is not None:
            out[:, x] = (scan[:, right if left is None else left] + scan[:, left if right is None else right]) // 2
    return out


def destripe_by_windows(pixels: DataFrame) -> DataFrame:
    """``destripe`` of pages of any size."""
    flags = cut(_streaks(pixels))
    # runs are at most three wide, so the clean neighbours lie within three columns
    near = F.explode(F.array(*[F.lit(d) for d in range(-STREAK_WIDTH, STREAK_WIDTH + 1) if d]))
    cand = flags.select("page_id", "x", "width", near.alias("d")).withColumn("nx", F.col("x") + F.col("d"))
    clean = cand.join(flags.select("page_id", F.col("x").alias("nx")), ["page_id", "nx"], "left_anti")
    sides = clean.filter("nx >= 0 AND nx < width").groupBy("page_id", "x").agg(
        F.max(F.when(F.col("d") < 0, F.col("nx"))).alias("l"), F.min(F.when(F.col("d") > 0, F.col("nx"))).alias("r"))
    # at most an eighth of a page's columns is flagged, so they ride with the page; pages without any pass by
    p = with_page(pixels, sides.groupBy("page_id").agg(F.collect_list(F.struct("x", "l", "r")).alias("_hot")), "left")
    at = p.filter("_hot IS NOT NULL").withColumn("_to", F.try_element_at(F.filter("_hot", lambda q: q["x"] == F.col("x")), F.lit(1)))
    kinds, steps = dict(pixels.dtypes), range(1, STREAK_WIDTH + 1)

    def beside(c, step, side):
        return F.coalesce(*[F.when(step("x", d).over(along_row()) == F.col(f"_to.{side}"), step(c, d).over(along_row())) for d in steps])

    at = at.withColumns({f"_{side}{c}": beside(c, step, side) for c in RGB for step, side in ((F.lag, "l"), (F.lead, "r"))})

    def mended(c):
        left, right = F.col(f"_l{c}"), F.col(f"_r{c}")
        return F.coalesce(F.floor((F.coalesce(left, right) + F.coalesce(right, left)) / 2), F.col(c)).cast(kinds[c]).alias(c)

    return p.filter("_hot IS NULL").select(*pixels.columns).unionAll(at.select(*[mended(c) if c in RGB else F.col(c) for c in pixels.columns]))


# ---------------------------------------------------------------- colours of boxes


def _boxes_by_page(boxes: DataFrame) -> DataFrame:
    """(page_id, _boxes): the boxes of a page that has at most ``FEW_BOXES``, null for any other."""
    slim = boxes.select("page_id", F.struct("box_id", "x0", "y0", "x1", "y1").alias("_box"))
    n = slim.groupBy("page_id").agg(F.count("*").alias("_n"))
    few = slim.join(n.filter(F.col("_n") <= FEW_BOXES), "page_id").groupBy("page_id").agg(F.collect_list("_box").alias("_boxes"))
    return n.select("page_id").join(few, "page_id", "left")


def _within(q: Column, pad: int = 0) -> Column:
    x, y = F.col("x"), F.col("y")
    return (x >= q["x0"] - pad) & (x < q["x1"] + pad) & (y >= q["y0"] - pad) & (y < q["y1"] + pad)


def pixels_near_boxes(pixels: DataFrame, boxes: DataFrame, pad: int) -> DataFrame:
    """Pixels at most ``pad`` px off a box; a page of many boxes keeps all its pixels."""
    p = with_page(pixels, _boxes_by_page(boxes))
    return p.filter(F.col("_boxes").isNull() | F.exists("_boxes", lambda q: _within(q, pad))).drop("_boxes")


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, cell: int = 64) -> DataFrame:
    """Pixels with the ``box_id`` of every box of their page they lie in.

    Few boxes ride with their page, whose pixels stay where they are; on a page of many they are found by an equi-join on grid cells.
    """
    few, many = pixels_by_crowding(pixels, boxes, cell)
    return few.unionByName(many)


def pixels_by_crowding(pixels: DataFrame, boxes: DataFrame, cell: int = 64) -> tuple[DataFrame, DataFrame]:
    """``pixels_in_boxes`` of pages with few boxes, which still lie with their page, and of pages with many."""
    held = with_page(pixels, _boxes_by_page(boxes))
    few = held.filter("_boxes IS NOT NULL").withColumn("_box", F.explode(F.filter("_boxes", lambda q: _within(q)))).select(*pixels.columns, "_box.*")
    crowded = _boxes_by_page(boxes).filter("_boxes IS NULL").select("page_id")
    many = _in_cells(with_page(pixels, crowded, "left_semi"), boxes.join(crowded, "page_id", "left_semi"), cell)
    return few, many


def _in_cells(pixels: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.expr(f"{lo} div {cell}"), F.expr(f"({hi} - 1) div {cell}"))
    b = boxes.select("page_id", "box_id", "x0", "y0", "x1", "y1").withColumn("cx", F.explode(span("x0", "x1"))).withColumn(
        "cy", F.explode(span("y0", "y1")))
    p = pixels.withColumn("cx", F.expr(f"x div {cell}")).withColumn("cy", F.expr(f"y div {cell}"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return p.join(b.hint("shuffle_hash"), ["page_id", "cx", "cy"]).filter(inside).drop("cx", "cy")


def ink_colour(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean colour of each box's solid ink; black when it has none."""
    solid = pixels_in_boxes(pixels.filter(F.col("a") > SOLID_INK).select("page_id", "y", "x", *RGB), boxes)
    m = solid.groupBy("page_id", "box_id").agg(*[F.avg(c).alias(c) for c in RGB])
    return boxes.select("page_id", "box_id").join(m, ["page_id", "box_id"], "left").fillna(0.0, list(RGB))


def nearest_colour(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """Each page colour with the nearest entry of its page's palette (squared distance, first on a tie).

    ``colours`` holds distinct colours, ``palette`` (page_id, rank, r, g, b) at most a handful of rows per page; they
    travel as one array, so nothing is multiplied out.
    """
    entry = F.struct("rank", *RGB)
    pal = palette.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("palette"))
    best = F.array_min(F.transform("palette", lambda p: F.struct(
        sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in RGB), F.lit(0)).alias("d"), p["rank"].alias("rank"),
        *[p[c].alias(c) for c in RGB])))
    return colours.join(pal, "page_id").withColumn("_n", best).select(
        *colours.columns, *[F.col(f"_n.{c}").alias(f"near_{c}") for c in RGB])


def _white_ink(c: Column, spread: int) -> Column:
    low, high = F.least(c["r"], c["g"], c["b"]), F.greatest(c["r"], c["g"], c["b"])
    white = F.struct(*[F.lit(255).alias(ch) for ch in RGB])
    return F.when((low >= 215) & (high - low <= spread), white).otherwise(F.struct(*[c[ch].alias(ch) for ch in RGB]))


def palette_census(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Inks per box in order of share, from a histogram of 32 steps per channel.

    Near-white is white, an ink within 40 of a commoner one is that one, and one under 1 % is a blend, though two are
    always kept. A histogram has a fixed number of bins, so the fold over it is bounded whatever the box holds.
    """
    solid = pixels_in_boxes(pixels.filter(F.col("a") >= 250).select("page_id", "y", "x", *RGB), boxes)
    bins = solid.groupBy("page_id", "box_id", *[F.shiftright(c, 3).alias(f"q{c}") for c in RGB]).agg(
        F.count("*").alias("n"), *[F.bround(F.avg(c)).cast("int").alias(c) for c in RGB])
    lists = bins.groupBy("page_id", "box_id").agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "qr", "qg", "qb", *RGB))).alias("bins"))
    empty = F.array().cast("array<struct<r:int,g:int,b:int,n:bigint>>")

    def keep(acc, b):
        c = _white_ink(b, 20)
        n = -b["k"]
        rare = (n < PALETTE_SHARE * F.col("total")) & (F.size(acc) >= 2)
        known = F.exists(acc, lambda q: sum((F.abs(q[ch] - c[ch]) for ch in RGB), F.lit(0)) <= PALETTE_MERGE)
        item = F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), n.alias("n"))
        return F.when(rare | known | (F.size(acc) >= PALETTE_SIZE), acc).otherwise(F.array_append(acc, item))

    inks = lists.withColumn("inks", F.aggregate("bins", empty, keep))
    return inks.select("page_id", "box_id", "total", F.posexplode("inks").alias("rank", "i")).select(
        "page_id", "box_id", "rank", "i.r", "i.g", "i.b", (F.col("i.n") / F.col("total")).alias("share"))


# fixed values: the least share of an ink, how close two inks are one (dark ones and others), what lies between two inks
RARE_INK, DARK_LUMA, ONE_DARK_INK, ONE_INK = 0.004, 70, 60, 40
MIX_MIDDLE, MIX_AWAY = (0.15, 0.85), 28


def palette_kmeans(pixels: DataFrame, k: int = 10, seed: int = 7) -> DataFrame:
    """Inks of the whole corpus by k-means over its distinct colours weighted by count.

    Clusters under 0.4 % go (two are kept), near-white is white, dark inks closer than 60 (others 40) are one, and an ink
    that is a blend of two others is dropped.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    colours = pixels.filter(F.col("a") >= 250).groupBy(*RGB).agg(F.count("*").cast("double").alias("n"))
    data = VectorAssembler(inputCols=list(RGB), outputCol="features").transform(colours).select("features", "n")
    model = KMeans(k=k, seed=seed, weightCol="n", maxIter=15, predictionCol="cluster").fit(data)
    centres = model.clusterCenters()
    sized = model.transform(data).groupBy("cluster").agg(F.sum("n").alias("n"))
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(RGB, centre)]) for centre in centres])
    rows = sized.withColumn("c", F.element_at(table, F.col("cluster") + 1))
    inks = rows.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("k"), F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b")))).alias("inks"))
    empty = F.array().cast("array<struct<r:double,g:double,b:double,n:double>>")

    def gap(p, q):
        return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in RGB), F.lit(0.0)))

    def luma(p):
        return 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]

    def keep(acc, b):
        c = _white_ink(b, 30)
        n = -b["k"]
        rare = (n < RARE_INK * F.col("total")) & (F.size(acc) >= 2)
        same = F.exists(acc, lambda q: gap(q, c) < F.when((luma(c) < DARK_LUMA) & (luma(q) < DARK_LUMA), ONE_DARK_INK).otherwise(ONE_INK))
        item = F.struct(*[c[ch].cast("double").alias(ch) for ch in RGB], n.alias("n"))
        return F.when(rare | same, acc).otherwise(F.array_append(acc, item))

    kept = inks.withColumn("kept", F.aggregate("inks", empty, keep)).select("total", "kept")

    def product(p, q, o):
        """Inner product of two colours seen from a third."""
        return sum(((p[c] - o[c]) * (q[c] - o[c]) for c in RGB), F.lit(0.0))

    def mixed(c, a, b):
        """Whether a colour lies near the middle of the segment between two others."""
        span, along = product(b, b, a), product(c, b, a)
        away = product(c, c, a) - along * along / span
        return (span >= 1) & (along / span).between(*MIX_MIDDLE) & (away < MIX_AWAY ** 2)

    out = kept.select("total", "kept", F.posexplode("kept").alias("rank", "i")).filter(
        (F.col("rank") < 2) | ~F.exists("kept", lambda a: F.exists("kept", lambda b: F.coalesce(mixed(F.col("i"), a, b), F.lit(False)))))
    return out.select("rank", *[F.bround(f"i.{c}").cast("int").alias(c) for c in RGB], (F.col("i.n") / F.col("total")).alias("share"))
