"""Whole-corpus jobs: clean every page, judge every page, take the census of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import RGB, hex_of, mean_level
from ..operators import boxes as box_ops
from ..operators import gates, keying, raster, regions
from ..operators.tiles import page_sizes, with_page
from ..session import cut, is_empty, written
from . import cutting, held

# fixed values: dark backings, and hole sizes in millimetres
DARK_BACKING = 90
HOLE_MM, LETTER_MM = 0.3, 15
LEAST_DPI = 72
# fixed value: a photographed sheet has been set to white before it is keyed, whatever its border holds
PHOTO_WHITE = 250
CENSUS_GAP_MM, CENSUS_SIDE = 1.35, 24


def page_backing(pixels: DataFrame) -> DataFrame:
    """(page_id, cr, cg, cb, br, bg, bb): the colour keyed on, and the flat backdrop where the page has one.

    A dark digital backdrop is keyed on its exact fill, everything else on the border's median. The border's colours are
    counted once for both.
    """
    median = raster.border_median(pixels).select("page_id", *[F.col(c).alias(f"m{c}") for c in RGB])
    flat = raster.backdrop_mode(pixels).select("page_id", *[F.col(c).alias(f"b{c}") for c in RGB])
    dark = (mean_level("mr", "mg", "mb") < DARK_BACKING) & F.col("br").isNotNull()
    return median.join(flat, "page_id").select(
        "page_id", *[F.when(dark, F.col(f"b{c}")).otherwise(F.col(f"m{c}")).alias(f"c{c}") for c in RGB], *[f"b{c}" for c in RGB])


def page_kinds(pixels: DataFrame, backing: DataFrame) -> DataFrame:
    """(page_id, kind, neutral, grain, cr...bb)."""
    backing = cut(backing)
    on = backing.select("page_id", *[F.coalesce(f"b{c}", f"c{c}").alias(f"c{c}") for c in RGB])
    grain = raster.ink_grain(pixels, on).select("page_id", "grain")
    return keying.scan_or_digital(backing.join(grain, "page_id").withColumn("from_scan", F.lit(False)))


def keyed_backing(backing: DataFrame, kinds: DataFrame) -> DataFrame:
    """``backing`` with the white of photographs in place of their border's colour."""
    photo = F.coalesce(F.col("kind") == "photo", F.lit(False))
    return backing.join(kinds.select("page_id", "kind"), "page_id", "left").withColumns(
        {f"c{c}": F.when(photo, PHOTO_WHITE).otherwise(F.col(f"c{c}")) for c in RGB}).drop("kind")


def clean_corpus(pixels: DataFrame, backing: DataFrame | None = None, kinds: DataFrame | None = None, dpi: int = 300,
                 fill_holes: bool = True) -> DataFrame:
    """Keyed RGBA of every page by the verified recipe: key, overrides, fringe of photos, matte, white ink back in holes.

    Photographs are keyed on fixed white. Colours are the scan's own but for removed streaks; the key reads the untouched scan. What is known of a
    page is cut before pixels meet it. Pages a task can hold go through all steps in one pass (``held``), larger ones and incomplete rasters step by step.
    """
    backing = cut(page_backing(pixels) if backing is None else backing)
    if kinds is not None:
        kinds = cut(kinds)
        backing = cut(keyed_backing(backing, kinds))
    side = max(4, int(round(HOLE_MM / 25.4 * max(LEAST_DPI, dpi))))
    letter = int(round(LETTER_MM / 25.4 * max(LEAST_DPI, dpi)))
    sizes = cut(page_sizes(pixels))
    whole = sizes.filter("whole").select("page_id")
    page = backing.withColumn("kind", F.lit(None).cast("string")) if kinds is None else backing.join(kinds.select("page_id", "kind"), "page_id", "left")
    out = held.clean_held(with_page(pixels.drop("a"), whole, "left_semi"), page, side, int(1.5 * side * side), letter, DARK_BACKING, fill_holes, kinds is not None)
    if is_empty(sizes.filter("NOT whole")):
        return out
    return out.unionByName(_clean_by_steps(with_page(pixels, whole, "left_anti"), backing, kinds, side, letter, fill_holes))


def _clean_by_steps(pixels: DataFrame, backing: DataFrame, kinds: DataFrame | None, side: int, letter: int, fill_holes: bool) -> DataFrame:
    """``clean_corpus`` of pages of any size. The untouched scan rides beside the mended colours, so a page goes through all steps once; the keyed
    pages are cut once, because holes are looked for in them."""
    carrier = backing.select("page_id", "cr", "cg", "cb")
    rgb_only = pixels.drop("a")
    strips = cut(raster.edge_strips(rgb_only))
    mended = {f"mended_{c}": c for c in RGB}
    both = raster.destripe_by_windows(rgb_only.withColumns({f"scan_{c}": F.col(c) for c in RGB})).withColumnsRenamed({c: m for m, c in mended.items()})
    keyed = keying.carrier_alpha(both.withColumnsRenamed({f"scan_{c}": c for c in RGB}), carrier)
    keyed = keying.alpha_overrides(keyed, carrier, strips)
    if kinds is not None:
        photos = kinds.filter("kind = 'photo'").select("page_id")
        keyed = keyed if is_empty(photos) else _without_fringe(cut(keyed), photos)
    clean = cut(keying.clean_matte(keyed.drop(*RGB)).withColumnsRenamed(mended).select(*rgb_only.columns, "a"))
    if not fill_holes:
        return clean
    tinted = carrier.filter(~keying.is_neutral())
    clear = regions.clear_runs(clean)
    holes = regions.enclosed_holes(clean, side, int(1.5 * side * side), tinted, letter, clear)
    light = carrier.filter(mean_level("cr", "cg", "cb") >= DARK_BACKING).select("page_id", keying.is_neutral().alias("neutral"))
    holes = holes.join(light, "page_id")
    if kinds is not None:
        # digital art on white: whatever an outline shuts in is its white ink
        holes = holes.join(kinds.select("page_id", "kind"), "page_id").withColumn(
            "fill", F.col("fill") | (F.col("neutral") & (F.col("kind") == "digital")))
    return keying.fill_holes(clean, cut(regions.hole_runs(clean, holes, clear)))


def _without_fringe(keyed: DataFrame, photos: DataFrame) -> DataFrame:
    runs = cut(regions.runs_of(keyed.join(photos, "page_id", "left_semi"), F.col("a") > regions.OPAQUE))
    small = regions.label_runs(regions.runs_of(regions.reduced_runs(runs), F.lit(True)))
    gone = cut(small.join(regions.fringe_among(small, runs), ["page_id", "comp_id"], "left_semi"))
    d = regions.DOWN
    full = gone.select("page_id", F.explode(F.sequence(F.col("y") * d, F.col("y") * d + d - 1)).alias("y"), (F.col("x0") * d).alias("x0"), (F.col("x1") * d).alias("x1"))
    marked = regions.covered_by_runs(keyed, full, "_fringe")
    return marked.withColumn("a", F.when(F.col("_fringe"), 0).otherwise(F.col("a"))).drop("_fringe")


def assess_corpus(pixels: DataFrame, dpi: int = 300, gap: int | None = None, resolutions: DataFrame | None = None) -> DataFrame:
    """One quality row per page: kind, sharpness, blocks, light, letters, opaque share, decals, scores and advice.

    ``resolutions`` has (page_id, native_dpi) of pages that know their own; without it every page is taken to be at ``dpi``.
    """
    gap = max(4, int(round(dpi / 25.4))) if gap is None else gap
    backing = cut(page_backing(pixels))
    kinds = cut(page_kinds(pixels, backing))
    measures = raster.sharpness_blockiness(pixels, keyed_backing(backing, kinds).select("page_id", "cr", "cg", "cb"))
    clean = written(clean_corpus(pixels, backing, kinds, dpi, fill_holes=False).select("page_id", "y", "x", "a", "width", "height"))
    opaque = clean.groupBy("page_id").agg(
        F.avg((F.col("a") > regions.OPAQUE).cast("int")).alias("opaque_share"), F.max("width").alias("width"), F.max("height").alias("height"))
    pieces = cutting.raw_pieces(clean)
    decals = cutting.segment_pieces(*pieces, gap).groupBy("page_id").agg(F.count("*").alias("decals"))
    letters = box_ops.letter_size(cutting.segment_pieces(*pieces, 0, min_side=6, pad=0)).select("page_id", "letters_px")
    rows = (
        opaque.join(kinds.select("page_id", "kind", "neutral"), "page_id").join(measures, "page_id")
        .join(decals, "page_id", "left").join(letters, "page_id", "left").fillna(0, ["decals"])
        .withColumn("photo", F.col("kind") == "photo")
    )
    if resolutions is None:
        rows = rows.withColumn("dpi_known", F.lit(True)).withColumn("native_dpi", F.lit(dpi))
    else:
        rows = rows.join(resolutions.select("page_id", "native_dpi"), "page_id", "left").withColumn("dpi_known", F.col("native_dpi").isNotNull()).withColumn(
            "native_dpi", F.coalesce("native_dpi", F.lit(dpi)))
    return keying.ramp_scores(rows).drop("photo", "dpi_known")


def census_corpus(pixels: DataFrame, dpi: int = 300) -> DataFrame:
    """A census row per page of a collection, with kept and leak where the picture is transparent itself.

    A page whose raster is incomplete gets a row with ``error`` and is kept out of all work, so it stops nothing.
    """
    size = cut(pixels.groupBy("page_id").agg(F.count("*").alias("n"), F.max("width").alias("w"), F.max("height").alias("h")))
    bad = size.filter("n <> w * h").select("page_id", F.format_string("%d of %d pixels", "n", F.col("w") * F.col("h")).alias("error"))
    good = pixels.join(size.filter("n = w * h").select("page_id"), "page_id", "left_semi")
    backing = cut(page_backing(good))
    kinds = cut(page_kinds(good, backing))
    # a picture's own alpha rides beside the cleaned one, so they need not be laid over each other; only what is measured is written
    clean = written(clean_corpus(good.withColumn("oa", F.col("a")), backing, kinds, dpi).select("page_id", "y", "x", "a", "oa", "width", "height"))
    gap = max(int(round(CENSUS_GAP_MM / 25.4 * dpi)), int(round(16 * dpi / 300)))
    decals = cutting.segment_sheet(clean, gap, min_side=CENSUS_SIDE).groupBy("page_id").agg(F.count("*").alias("decals"))
    truth = gates.kept_leak_beside(clean.withColumnRenamed("a", "ca")).select("page_id", "kept", "leak")
    backdrop = F.when(F.col("br").isNotNull(), hex_of("br", "bg", "bb"))
    rows = kinds.select("page_id", (F.col("kind") == "photo").alias("photo"), (F.col("kind") == "digital").alias("digital"), backdrop.alias("backdrop"))
    out = rows.join(decals, "page_id", "left").fillna(0, ["decals"]).join(truth, "page_id", "left")
    return out.unionByName(bad, allowMissingColumns=True)
