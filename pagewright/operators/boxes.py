"""Boxes on pages: selection, printed size, nearness, ownership, order, tiles and layout.

Boxes are half-open ``(x0, y0, x1, y1)`` in pixels, keyed by (page_id, box_id).
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_empty
from . import ordered
from .fold import ordered_fold

# fixed values: resolutions, grouping distance and scale presets
WORKING_DPI = 300
FINER_THAN_WORKING = 1.05
LEAST_GAP_PX = 16
MM_PER_INCH = 25.4
SCALE_PRESETS = {
    '1/12 — 6" Classified': 12, '1/18 — 3.75" (ARAH / Retro)': 18, '1/6 — 12" figure': 6,
    "1/10": 10, "1/16": 16, "1/24": 24, "1/35": 35, "1/48": 48,
}
SIZE_TOLERANCE = 0.06
HALVES_TOLERANCE = 0.08
HALVES_SHARE = 0.2
OWNER_SLACK = 4
PIECE_DPI = 300.0
SLICE_PX = 256
# boxes of a page that a task still holds at once
PAGE_ROWS = 4096
FEW_BOXES = 32
LETTER_MIN, LETTER_MAX, LETTER_LONG, LETTERS_NEEDED = 9, 90, 4, 5


# ---------------------------------------------------------------- pages


def parse_pages(spec: Column) -> tuple[Column, Column]:
    """(ranges, bad) of a page list such as ``all``, ``2``, ``1,3`` or ``2-4; 7``. Null ranges mean every page."""
    text = F.lower(F.regexp_replace(F.coalesce(spec, F.lit("")), r"\s+", ""))
    parts = F.filter(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda p: p != "")
    every = text.isin("", "all", "*") | (F.size(parts) == 0)
    shaped = F.forall(parts, lambda p: p.rlike(r"^[0-9]+(-[0-9]+)?$"))
    # no page has a number beyond a long, so a longer number stands for the largest; order is by digits
    bare = lambda d: F.regexp_replace(d, "^0+(?=.)", "")
    size = lambda d: F.struct(F.length(d).alias("n"), d.alias("d"))
    page = lambda d: F.coalesce(d.try_cast("long"), F.lit(2**63 - 1))
    ends = F.transform(parts, lambda p: F.struct(bare(F.split(p, "-")[0]).alias("lo"), bare(F.element_at(F.split(p, "-"), -1)).alias("hi")))
    ranges = F.transform(ends, lambda r: F.struct(page(r["lo"]).alias("lo"), page(r["hi"]).alias("hi")))
    sound = shaped & F.forall(ends, lambda r: (r["lo"] != "0") & (size(r["hi"]) >= size(r["lo"])))
    return F.when(~every, ranges), ~every & ~F.coalesce(sound, F.lit(False))


def page_select(pages: DataFrame, jobs: DataFrame, strict: bool = True) -> DataFrame:
    """Pages (job_id, page_no, ...) a job's ``spec`` asks for. A bad spec fails the query, or selects nothing if not strict."""
    ranges, bad = parse_pages(F.col("spec"))
    wanted = jobs.select("job_id", ranges.alias("_ranges"), bad.alias("_bad"), "spec")
    if strict:
        wanted = wanted.withColumn("_bad", F.when(
            F.col("_bad"), F.raise_error(F.concat(F.lit("not a page list: "), F.col("spec")))).otherwise(F.lit(False)))
    n = F.col("page_no")
    asked = F.col("_ranges").isNull() | F.exists("_ranges", lambda r: (n >= r["lo"]) & (n <= r["hi"]))
    return pages.join(wanted, "job_id").filter(~F.col("_bad") & asked).drop("_ranges", "_bad", "spec")


def recipe_gap(gap_mm: Column, dpi: Column) -> Column:
    """Grouping distance in px, never under 16 px at 300 dpi."""
    return F.greatest(F.bround(gap_mm / MM_PER_INCH * dpi), F.bround(LEAST_GAP_PX * dpi / 300.0)).cast("int")


def scale_factor(source: Column, target: Column) -> Column:
    """Resize factor between two figure scales; 1.0 when either makes no sense."""
    f = F.try_divide(source.cast("double"), target.cast("double"))
    return F.when(f > 0, f).otherwise(1.0)


def preset_scale(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SCALE_PRESETS.items() for x in kv])
    return F.try_element_at(table, name)


def page_geometry(pages: DataFrame) -> DataFrame:
    """Working size, grouping gap and printed size of pages or pieces.

    ``pages`` has (width, height, dpi, width_mm, gap_mm, source_scale, target_scale); the resolution comes from
    the file, else from a known real width, else it is taken as the working one.
    """
    measured = F.when(F.col("width_mm") > 0, F.col("width") / (F.col("width_mm") / MM_PER_INCH))
    dpi = F.coalesce(F.col("dpi").cast("double"), measured, F.lit(float(WORKING_DPI)))
    finer = F.col("native_dpi") > WORKING_DPI * FINER_THAN_WORKING
    k = WORKING_DPI / F.col("native_dpi")
    scale = scale_factor(preset_scale(F.col("source_scale")), preset_scale(F.col("target_scale")))

    def worked(c):
        return F.when(finer, F.greatest(F.lit(1), F.bround(F.col(c) * k).cast("int"))).otherwise(F.col(c))

    return (
        pages.withColumn("native_dpi", dpi)
        .withColumn("work_width", worked("width")).withColumn("work_height", worked("height"))
        .withColumn("work_dpi", F.when(finer, F.lit(float(WORKING_DPI))).otherwise(F.col("native_dpi")))
        .withColumn("gap_px", recipe_gap(F.col("gap_mm"), F.col("work_dpi")))
        .withColumn("scale", scale)
        .withColumn("w_in", F.col("width") / F.col("native_dpi") * F.col("scale"))
        .withColumn("h_in", F.col("height") / F.col("native_dpi") * F.col("scale"))
    )


# ---------------------------------------------------------------- range joins


def _cells(df: DataFrame, cell: int, reach: Column) -> DataFrame:
    def span(lo, hi):
        return F.sequence(F.floor((F.col(lo) - reach) / cell), F.floor((F.col(hi) + reach) / cell))

    return df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def overlap_join(left: DataFrame, right: DataFrame, gap: Column | int = 0, cell: int = 64) -> DataFrame:
    """Rows of two box tables of one page whose boxes come within ``gap`` px on both axes.

    An equi-join on (page, grid cell). Two boxes may share several cells, but only the one that holds the
    corner of their common area reports the pair, so nothing has to be made distinct afterwards.
    Columns come out as structs ``a`` and ``b``.
    """
    g = F.lit(gap) if isinstance(gap, int) else gap
    la = _cells(left.withColumn("_g", g), cell, F.col("_g")).select(
        "page_id", "cx", "cy", F.struct(*left.columns).alias("a"), "_g")
    rb = _cells(right, cell, F.lit(0)).select("page_id", "cx", "cy", F.struct(*right.columns).alias("b"))
    j = la.join(rb, ["page_id", "cx", "cy"])
    near = (
        (F.col("a.x0") - F.col("_g") <= F.col("b.x1")) & (F.col("b.x0") - F.col("_g") <= F.col("a.x1"))
        & (F.col("a.y0") - F.col("_g") <= F.col("b.y1")) & (F.col("b.y0") - F.col("_g") <= F.col("a.y1"))
    )
    here = (F.floor(F.greatest(F.col("a.x0") - F.col("_g"), F.col("b.x0")) / cell) == F.col("cx")) & (
        F.floor(F.greatest(F.col("a.y0") - F.col("_g"), F.col("b.y0")) / cell) == F.col("cy"))
    return j.filter(near & here).select("page_id", "a", "b")


def near_pairs(boxes: DataFrame, name: str, gap: int, cell: int = 64) -> DataFrame:
    """Pairs ``a``, ``b`` of one page (``a`` of the smaller ``name``) within ``gap`` px on both axes, each once.

    The few boxes most pages have meet inside the page's row, without a copy per grid cell; a page with more goes through the cells.
    """
    sized = boxes.withColumn("_n", F.count("*").over(Window.partitionBy("page_id")))
    few = sized.filter(F.col("_n").between(2, FEW_BOXES)).groupBy("page_id").agg(F.collect_list(F.struct(*boxes.columns)).alias("_all"))
    a = F.col("a")
    near = F.filter("_all", lambda b: (a[name] < b[name]) & (a["x0"] - gap <= b["x1"]) & (b["x0"] - gap <= a["x1"])
                    & (a["y0"] - gap <= b["y1"]) & (b["y0"] - gap <= a["y1"]))
    pairs = few.select("page_id", "_all", F.explode("_all").alias("a")).select("page_id", "a", F.explode(near).alias("b"))
    many = sized.filter(F.col("_n") > FEW_BOXES).drop("_n")
    return pairs.unionByName(overlap_join(many, many, gap, cell).filter(F.col(f"a.{name}") < F.col(f"b.{name}")))


def box_near_join(boxes: DataFrame, gap: int, cell: int = 64) -> DataFrame:
    """Pairs (box_a < box_b) of one page within ``gap`` px of each other on both axes."""
    slim = boxes.select("page_id", "box_id", "x0", "y0", "x1", "y1")
    return near_pairs(slim, "box_id", gap, cell).select(
        "page_id", F.col("a.box_id").alias("box_a"), F.col("b.box_id").alias("box_b"))


def box_owner(pieces: DataFrame, boxes: DataFrame, cell: int = 64, slack: int = OWNER_SLACK) -> DataFrame:
    """The box each piece (page_id, piece_id, x0..y1) belongs to: the smallest that holds it whole, within
    ``slack`` px, else the one it overlaps most. Candidates shrink to one per piece before the shuffle ends."""
    slim = boxes.select("page_id", "box_id", "x0", "y0", "x1", "y1")
    j = overlap_join(pieces.select("page_id", "piece_id", "x0", "y0", "x1", "y1"), slim, 0, cell)
    ix = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    iy = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    whole = (
        (F.col("b.x0") <= F.col("a.x0") + slack) & (F.col("b.y0") <= F.col("a.y0") + slack)
        & (F.col("a.x1") - slack <= F.col("b.x1")) & (F.col("a.y1") - slack <= F.col("b.y1"))
    )
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    rank = F.struct(
        F.when(whole, 0).otherwise(1).alias("part"), F.when(whole, area).otherwise(-ix * iy).alias("size"),
        F.col("b.box_id").alias("id"))
    owned = j.filter((ix > 0) & (iy > 0)).groupBy("page_id", F.col("a.piece_id").alias("piece_id")).agg(
        F.min(rank).alias("r"))
    return owned.select("page_id", "piece_id", F.col("r.id").alias("box_id"), (F.col("r.part") == 0).alias("whole"))


# ---------------------------------------------------------------- sizes


def size_classes(boxes: DataFrame) -> DataFrame:
    """Boxes of one exact size on a page, as one row with their count and three lowest ids.

    However many copies a page holds, its distinct sizes are few, so everything that compares sizes
    compares these.
    """
    w, h = (F.col("x1") - F.col("x0")), (F.col("y1") - F.col("y0"))
    sized = boxes.select("page_id", "box_id", w.alias("w"), h.alias("h"))
    low = sized.groupBy("page_id", "w", "h").agg(F.count("*").alias("n"), F.min("box_id").alias("first_id"))
    return low


def _exact(share: float) -> Column:
    """A share as the decimal it is written as: a double of it puts a size that lies right on a limit on either side."""
    return F.lit(Decimal(str(share)))


def size_within(a_w: Column, a_h: Column, b_w: Column, b_h: Column, tol: float) -> Column:
    tol = _exact(tol)
    return (F.abs(a_w - b_w) <= tol * F.greatest(a_w, b_w)) & (F.abs(a_h - b_h) <= tol * F.greatest(a_h, b_h))


def _size_bucket(long_side: Column, tol: float) -> Column:
    return F.floor(F.log(long_side.cast("double")) / -math.log(1 - tol)).cast("int")


def match_sizes(left: DataFrame, right: DataFrame, tol: float) -> DataFrame:
    """Joins two tables with (page_id, w, h) where sizes agree straight or turned a quarter.

    Equal within ``tol`` means long sides at most one logarithmic step apart, so an equi-join on the
    step and its neighbours finds every match.
    """
    def step(df):
        return _size_bucket(F.greatest(F.col("w"), F.col("h")), tol)

    la = left.withColumn("_k", F.explode(F.array(*[step(left) + d for d in (-1, 0, 1)]))).select(
        "page_id", "_k", F.struct(*left.columns).alias("a"))
    rb = right.select("page_id", step(right).alias("_k"), F.struct(*right.columns).alias("b"))
    straight = size_within(F.col("a.w"), F.col("a.h"), F.col("b.w"), F.col("b.h"), tol)
    quarter = size_within(F.col("a.w"), F.col("a.h"), F.col("b.h"), F.col("b.w"), tol)
    return la.join(rb, ["page_id", "_k"]).withColumn("same", straight).withColumn("quarter", quarter).filter(
        "same OR quarter").drop("_k")


def size_match_join(boxes: DataFrame, tol: float = SIZE_TOLERANCE) -> DataFrame:
    """Which sizes of a page can hold copies of one another: pairs of size classes, each once.

    A class is paired with itself when it has two or more boxes. ``n_pairs`` counts the box pairs behind a row.
    """
    c = size_classes(boxes)
    j = match_sizes(c, c, tol).filter("(a.w, a.h) <= (b.w, b.h)")
    self_pair = (F.col("a.w") == F.col("b.w")) & (F.col("a.h") == F.col("b.h"))
    n = F.when(self_pair, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    return j.select(
        "page_id", F.col("a.w").alias("w"), F.col("a.h").alias("h"), F.col("b.w").alias("w2"), F.col("b.h").alias("h2"),
        "same", "quarter", F.col("a.first_id").alias("first_a"), F.col("b.first_id").alias("first_b"), n.alias("n_pairs"),
    ).filter("n_pairs > 0")


def split_halves(boxes: DataFrame, gap: int, tol: float = HALVES_TOLERANCE) -> DataFrame:
    """Neighbouring boxes whose union has the size of a third box of the page.

    Neighbours overlap by more than half on one axis and lie within three gaps on the other; each is
    at least a fifth of the union. ``like`` is the first box of a matching size other than the two.
    """
    j = near_pairs(boxes.select("page_id", "box_id", "x0", "y0", "x1", "y1"), "box_id", 3 * gap)

    def side(t, lo, hi):
        return F.col(f"{t}.{hi}") - F.col(f"{t}.{lo}")

    def common(lo, hi):
        return F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}")

    def apart(lo, hi):
        return F.greatest(f"a.{lo}", f"b.{lo}") - F.least(f"a.{hi}", f"b.{hi}")

    beside = (common("x0", "x1") > 0.5 * F.least(side("a", "x0", "x1"), side("b", "x0", "x1"))) & (apart("y0", "y1") <= 3 * gap)
    above = (common("y0", "y1") > 0.5 * F.least(side("a", "y0", "y1"), side("b", "y0", "y1"))) & (apart("x0", "x1") <= 3 * gap)
    union = j.filter(beside | above).select(
        "page_id", F.col("a.box_id").alias("box_a"), F.col("b.box_id").alias("box_b"),
        F.least("a.x0", "b.x0").alias("x0"), F.least("a.y0", "b.y0").alias("y0"),
        F.greatest("a.x1", "b.x1").alias("x1"), F.greatest("a.y1", "b.y1").alias("y1"),
        F.least(side("a", "x0", "x1") * side("a", "y0", "y1"), side("b", "x0", "x1") * side("b", "y0", "y1")).alias("least"),
    ).withColumn("w", F.col("x1") - F.col("x0")).withColumn("h", F.col("y1") - F.col("y0"))
    real = union.filter(F.col("least") >= _exact(HALVES_SHARE) * F.col("w") * F.col("h")).drop("least")
    # the two halves can take up two places of a class, so its three lowest ids always hold the answer
    ids = Window.partitionBy("page_id", "w", "h").orderBy("box_id")
    low = (
        boxes.select("page_id", "box_id", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
        .withColumn("_n", F.row_number().over(ids)).filter("_n <= 3").drop("_n")
    )
    m = match_sizes(real, low, tol).filter("b.box_id <> a.box_a AND b.box_id <> a.box_b")
    return m.groupBy("page_id", "a.box_a", "a.box_b", "a.x0", "a.y0", "a.x1", "a.y1").agg(F.min("b.box_id").alias("like"))


def letter_size(pieces: DataFrame) -> DataFrame:
    """Median short side of letter-like pieces per page; null under five of them."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    small, big = F.least(w, h), F.greatest(w, h)
    is_letter = (small >= LETTER_MIN) & (big <= LETTER_MAX) & (big <= LETTER_LONG * small)
    short = F.when(is_letter, small)
    return pieces.groupBy("page_id").agg(
        F.count(short).alias("letters"), F.when(F.count(short) >= LETTERS_NEEDED, F.median(short)).alias("letters_px"))


# ---------------------------------------------------------------- order and layout


def _islands(df: DataFrame, order: list[Column], starts: Column) -> DataFrame:
    """Adds ``island``: a running count, per page, of rows that certainly begin something new. ``df`` carries slices."""
    return ordered.running_sum(df, ["page_id"], order, starts.cast("int"), "island")


def reading_order(boxes: DataFrame, first_n: int | None = None) -> DataFrame:
    """Adds ``row_no`` and ``order_no``: rows top to bottom, then left to right.

    A box joins the running row when it overlaps its growing band by more than 40 % of the smaller
    height. The band makes this a fold over the boxes in (y0, x0) order, and a page of few boxes is one group of a task. But a box below
    everything before it always starts a row, so a crowded page is shared out in the islands between such boxes.
    """
    crowded = _crowded_pages(boxes)
    if is_empty(crowded):
        out = _order_held(boxes)
    else:
        same = F.col("page_id").eqNullSafe(F.col("_page"))
        out = _order_held(boxes.join(crowded, same, "left_anti")).unionByName(_order_sliced(boxes.join(crowded, same, "left_semi")))
    return out if first_n is None else out.filter(F.col("order_no") <= first_n)


def _crowded_pages(df: DataFrame) -> DataFrame:
    """(_page): pages of more rows than a task holds at once."""
    return df.groupBy(F.col("page_id").alias("_page")).agg(F.count("*").alias("_n")).filter(F.col("_n") > PAGE_ROWS).select("_page")


def _reading_step(state, row):
    y0, y1 = row
    n, top, low = state
    if n and min(low, y1) - max(top, y0) > 0.4 * min(y1 - y0, low - top):
        return (n, min(top, y0), max(low, y1)), (n,)
    return (n + 1, y0, y1), (n + 1,)


def _order_held(boxes: DataFrame) -> DataFrame:
    """``reading_order`` of pages of which each fits in memory: one shuffle by page, rows and places in one pass over the sorted boxes."""
    cols = boxes.columns

    def placed(t: pa.Table) -> pa.Table:
        page, rows, at, state = [], [], -1, (0, 0, 0)
        before = object()
        for key, *row in zip(t["page_id"].to_pylist(), *(t[c].to_numpy().tolist() for c in ("y0", "y1"))):
            if key != before:
                before, at, state = key, at + 1, (0, 0, 0)
            state, (n,) = _reading_step(state, row)
            page.append(at)
            rows.append(n)
        page = np.array(page)
        # boxes come by (y0, x0, box_id) and the sort is stable, so equal places go by box_id
        by = np.lexsort((t["y0"].to_numpy(), t["x0"].to_numpy(), np.array(rows), page))
        order = np.empty(len(by), np.int32)
        order[by] = np.arange(len(by)) - np.searchsorted(page, page) + 1
        return t.append_column("row_no", pa.array(rows, pa.int32())).append_column("order_no", pa.array(order))

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            keys = t["page_id"].to_pylist()
            # the last page may go on in the next batch
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            if last:
                yield from placed(t.slice(0, last)).to_batches()
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from placed(held).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema.fields) + ", row_no int, order_no int"
    return boxes.repartition("page_id").sortWithinPartitions("page_id", "y0", "x0", "box_id").select(*cols).mapInArrow(run, schema)


def _order_sliced(boxes: DataFrame) -> DataFrame:
    """``reading_order`` of pages of any size, in slices and islands."""
    order, down = ["y0", "x0", "box_id"], [F.col("y0"), F.col("x0"), F.col("box_id")]
    across = [F.col("row_no"), F.col("x0"), F.col("y0"), F.col("box_id")]
    sliced = boxes.withColumn(ordered.SLICE, F.floor(F.col("y0") / SLICE_PX))
    lowest = ordered.running_max(sliced, ["page_id"], down, F.col("y1"), "_low")
    above = ordered.previous(lowest, ["page_id"], down, F.col("_low"), "_above")
    shared = _islands(above, down, F.col("_above").isNull() | (F.col("y0") >= F.col("_above"))).select(*boxes.columns, "island")
    rows = ordered_fold(shared, ["page_id", "island"], order, lambda: (0, 0, 0), _reading_step, ["y0", "y1"], "_row int")
    before = Window.partitionBy("page_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    per_island = rows.groupBy("page_id", "island").agg(F.max("_row").alias("_rows")).select(
        "page_id", "island", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = rows.join(per_island, ["page_id", "island"]).withColumn("row_no", (F.col("_before") + F.col("_row")).cast("int"))
    placed = ordered.number_rows(numbered.withColumn(ordered.SLICE, F.col("island")), ["page_id"], across, "order_no")
    return placed.select(*boxes.columns, "row_no", F.col("order_no").cast("int").alias("order_no"))


def text_rows(pieces: DataFrame, page_ink: DataFrame) -> DataFrame:
    """Which pieces of a page are lettering set in rows, and whether the page is text.

    ``pieces`` has (page_id, piece_id, x0..y1, area, r, g, b) with mean colours, ``page_ink`` (page_id, total).
    Returns one row per page: text flag, ink share in rows, number of rows and median letter height.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    p = pieces.join(page_ink, "page_id").withColumn("w", w).withColumn("h", h)
    word = F.expr("w >= 2.5 * h AND w <= 12 * h AND area / (w * h) < 0.88")
    letter = F.expr("h <= 6 * w AND w <= 3 * h AND area <= 0.45 * total")
    marks = p.filter(F.col("total") >= 20).filter((F.col("area") >= 4) & (F.col("h") >= 6) & (word | letter))
    # upper middle of the heights, from their counts
    heights = marks.groupBy("page_id", "h").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("page_id").orderBy("h")
    every = Window.partitionBy("page_id")
    med = (
        heights.withColumn("cum", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(every))
        .filter(F.expr("cum > n div 2")).groupBy("page_id").agg(F.min("h").alias("med_h"))
    )
    centred = marks.join(med, "page_id").withColumn("cy", (F.col("y0") + F.col("y1") - 1) / 2.0)

    def step(state, row):
        cy, med_h = row
        n, mean, count = state
        if n and abs(cy - mean) <= 0.6 * med_h:
            return (n, (mean * count + cy) / (count + 1), count + 1), (n,)
        return (n + 1, cy, 1), (n + 1,)

    def islands(df):
        # a centre further than the reach below the one before it starts a row whatever the running mean is
        across = [F.col("cy"), F.col("piece_id")]
        prior = ordered.previous(df.withColumn(ordered.SLICE, F.floor(F.col("cy") / SLICE_PX)), ["page_id"], across, F.col("cy"), "_prior")
        shared = _islands(prior, across, F.col("_prior").isNull() | (F.col("cy") - F.col("_prior") > 0.6 * F.col("med_h")))
        return shared.select(*df.columns, "island")

    # a page of few pieces is one island; only crowded ones are shared out
    crowded = _crowded_pages(pieces)
    whole = F.lit(0).cast("bigint").alias("island")
    if is_empty(crowded):
        shared = centred.select("*", whole)
    else:
        same = F.col("page_id").eqNullSafe(F.col("_page"))
        shared = centred.join(crowded, same, "left_anti").select("*", whole).unionByName(islands(centred.join(crowded, same, "left_semi")))
    rows = ordered_fold(
        shared, ["page_id", "island"], ["cy", "piece_id"], lambda: (0, 0.0, 0), step, ["cy", "med_h"], "row_no int")
    stats = rows.groupBy("page_id", "island", "row_no").agg(
        F.count("*").alias("items"), F.bool_or(F.expr("w >= 2.5 * h")).alias("wordy"),
        (F.max("y1") - F.min("y0")).alias("row_h"), F.sum("area").alias("row_area"),
        *[(F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(f"m{c}") for c in "rgb"],
    )
    kept = rows.join(stats, ["page_id", "island", "row_no"]).filter("(items >= 2 OR wordy) AND row_h >= 0.5 * med_h").withColumn(
        "near", F.expr("sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)) <= 80"))
    per_row = kept.groupBy("page_id", "island", "row_no").agg(
        F.coalesce(F.sum(F.when(F.col("near"), F.col("area"))), F.first("row_area")).alias("ink"))
    found = per_row.groupBy("page_id").agg(F.sum("ink").alias("ink"), F.count("*").alias("lines"))
    share = F.coalesce(F.col("ink"), F.lit(0)) / F.col("total")
    return page_ink.join(found, "page_id", "left").join(med, "page_id", "left").select(
        "page_id", F.coalesce(share >= 0.85, F.lit(False)).alias("text"), share.alias("share"),
        F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("med_h", F.lit(0)).alias("letter_px"))


def tile_split(pieces: DataFrame, avail_w: float, avail_h: float, overlap: float = 0.2) -> DataFrame:
    """Pieces (job_id, piece_id, w_in, h_in); one too big for the page becomes overlapping tiles."""
    step_w, step_h = max(0.5, avail_w - overlap), max(0.5, avail_h - overlap)
    w, h = F.col("w_in"), F.col("h_in")
    big = (w > avail_w + 1e-6) | (h > avail_h + 1e-6)

    def count(side, step):
        return F.when(big, F.greatest(F.lit(1), F.ceil((side - overlap) / step))).otherwise(F.lit(1)).cast("int")

    tiled = (
        pieces.withColumn("nx", count(w, step_w)).withColumn("ny", count(h, step_h))
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    )
    x0, y0 = F.col("col") * step_w, F.col("row") * step_h
    part = F.col("row") * F.col("nx") + F.col("col") + 1
    # fixed value: what is printed on a tile
    label = F.format_string(f"part %d of %d (row %d, column %d; {overlap:.2f} in overlap)", part, F.col("nx") * F.col("ny"),
                            F.col("row") + 1, F.col("col") + 1)
    is_tile = F.col("w_in").isNotNull() & big
    return tiled.select(
        "job_id", "piece_id", part.alias("part"), F.when(is_tile, label).otherwise("").alias("tile"),
        F.when(is_tile, F.least(w, x0 + avail_w) - x0).otherwise(w).alias("tile_w"),
        F.when(is_tile, F.least(h, y0 + avail_h) - y0).otherwise(h).alias("tile_h"))


def piece_table(entries: DataFrame, boxes: DataFrame) -> DataFrame:
    """Printable pieces with their size in inches.

    ``entries`` has (entry_id, label, px_w, px_h, w_in, h_in); a missing size falls back to pixels at 300 dpi.
    ``boxes`` (entry_id, order_no, x0..y1) cut a sheet into its pieces; an entry without boxes is one piece.
    """
    no_size = F.coalesce("w_in", F.lit(0.0)) * F.coalesce("h_in", F.lit(0.0)) == 0
    sized = entries.withColumn("_w", F.when(no_size, F.col("px_w") / PIECE_DPI).otherwise(F.col("w_in"))).withColumn(
        "_h", F.when(no_size, F.col("px_h") / PIECE_DPI).otherwise(F.col("h_in")))
    dpi = F.col("px_w") / F.col("_w")
    cut = F.col("order_no").isNotNull()
    return sized.join(boxes, "entry_id", "left").select(
        "entry_id", F.coalesce("order_no", F.lit(1)).alias("piece_no"),
        F.when(cut, F.format_string("%s %02d", "label", "order_no")).otherwise(F.col("label")).alias("label"),
        F.when(cut, (F.col("x1") - F.col("x0")) / dpi).otherwise(F.col("_w")).alias("w_in"),
        F.when(cut, (F.col("y1") - F.col("y0")) / dpi).otherwise(F.col("_h")).alias("h_in"))


def shelf_layout(tiles: DataFrame, paper: tuple[float, float], margin: float = 0.4, gap: float = 0.12) -> DataFrame:
    """Places (job_id, piece_id, part, tile_w, tile_h) on pages at true size: shelves from the top left, taller first.

    Pieces come tallest first, so a shelf is as high as its first piece and where shelves end depends on widths alone: first
    pieces are dealt to shelves, then shelves, far fewer, to pages. Each is one fold per job; jobs run side by side.
    """
    wide, high = paper[0] - 2 * margin, paper[1] - 2 * margin
    if min(wide, high) <= 0.5:
        raise ValueError(f"margins of {margin} in leave less than half an inch of a {paper[0]} x {paper[1]} in page")
    slack = 1e-6

    def along(state, row):
        shelf, right = state
        left = right if shelf and right + row[0] <= wide + slack else 0.0
        shelf += left == 0.0 or not shelf
        return (shelf, left + row[0] + gap), (shelf, margin + left)

    def down(state, row):
        page, bottom = state
        top = bottom if page and bottom + row[0] <= high + slack else 0.0
        page += top == 0.0 or not page
        return (page, top + row[0] + gap), (page, margin + top)

    shelved = ordered_fold(tiles, ["job_id"], ["tile_h", "piece_id", "part"], lambda: (0, 0.0), along, ["tile_w"], "_shelf int, x_in double",
                           ascending=[False, True, True])
    shelves = shelved.groupBy("job_id", "_shelf").agg(F.max("tile_h").alias("_h"))
    paged = ordered_fold(shelves, ["job_id"], ["_shelf"], lambda: (0, 0.0), down, ["_h"], "page_no int, y_in double")
    return shelved.join(paged.drop("_h"), ["job_id", "_shelf"]).select(*tiles.columns, "page_no", "x_in", "y_in")
