"""How often regions look at what they are made of."""

import numpy as np
from pyspark.sql import functions as F

from pagewright.checks.registry import Tables
from pagewright.checks.sheets import sheet_pixels
from pagewright.operators import copies, gates, graphs, raster, regions
from pagewright.plans import corpus, cutting

from .pages import pixel_table


def _components(spark, edges, **how):
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "page_id long, a long, b long")
    n = spark.createDataFrame([(1, i) for i in {i for e in edges for i in e} | {10_000}], "page_id long, node long")
    return {r["node"]: r["comp"] for r in graphs.connected_components(n, e, ["page_id"], **how).collect()}


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    cuts, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: cuts.append(1) or cut(df))
    chain = [(i * 7 % 500, (i + 1) * 7 % 500) for i in range(400)]
    got = _components(spark, chain)
    ends = {i * 7 % 500 for i in range(401)}
    assert got == {**dict.fromkeys(ends, 0), 10_000: 10_000} and len(cuts) <= 2


def test_a_group_of_many_slices(spark):
    chain = [(i, i + 1) for i in range(40)] + [(50, 51), (60, 51)]
    assert _components(spark, chain, slice_edges=5) == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50, 60: 50, 10_000: 10_000}


def _counted(spark, pixels):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return pixels.mapInArrow(count, pixels.schema), seen


def _page():
    a = np.zeros((60, 80, 4), int)
    a[10:40, 10:40] = (30, 30, 30, 255)
    a[10:40, 46:76] = (30, 30, 30, 255)
    return a


def test_a_sheet_is_cut_with_one_look_at_its_pixels(spark):
    p, seen = _counted(spark, pixel_table(spark, {1: _page()}))
    assert cutting.segment_sheet(p, gap=2, min_side=8, pad=0).count() == 2
    assert seen.value == 60 * 80


def test_a_page_is_cleaned_with_few_looks_at_its_pixels(spark):
    page = np.full((60, 80, 3), 250)
    page[20:40, 20:50] = (190, 20, 30)
    p, seen = _counted(spark, pixel_table(spark, {1: page}))
    backing = corpus.page_backing(p)
    assert corpus.clean_corpus(p, backing, corpus.page_kinds(p, backing)).count() == 60 * 80
    # borders, grain, edges, streaks, and the two ways a page can be mended and keyed
    assert seen.value <= 12 * 60 * 80, seen.value / 4800


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grain_meets_the_backdrop_below_the_tiles(spark):
    p = pixel_table(spark, {1: _page()}).repartition(3, "page_id")
    plan = _plan(raster.ink_grain(p, raster.border_median(p).withColumnsRenamed({c: f"c{c}" for c in "rgb"})))
    assert "Join" not in plan[:plan.index("FlatMapGroupsInArrow")]


def _flooded(mask, diagonal):
    """(least place, area) of every region, found by walking."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    h, w = mask.shape
    left, found = set(zip(*np.nonzero(mask))), set()
    while left:
        region = [left.pop()]
        for y, x in region:
            for dy, dx in near:
                if (y + dy, x + dx) in left:
                    left.remove((y + dy, x + dx))
                    region.append((y + dy, x + dx))
        found.add((min(int(y) * w + int(x) for y, x in region), len(region)))
    return found


def test_regions_of_pages_of_few_and_of_many_runs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pages = {i: np.full((h, w, 4), 255) for i, (h, w) in enumerate([(9, 11), (30, 31), (6, 5), (1, 40), (25, 8), (4, 4)])}
    for a in pages.values():
        a[:, :, 3] = rng.integers(0, 2, a.shape[:2]) * 255
    p = pixel_table(spark, pages).repartition(1, "page_id")
    sizes = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(sizes)
    try:
        for most, rows in ((1 << 17, 10_000), (1 << 17, 7), (40, 10_000), (40, 7), (0, 7)):
            monkeypatch.setattr(regions, "PAGE_RUNS", most)
            spark.conf.set(sizes, rows)
            for diagonal in (True, False):
                got = {}
                for r in regions.components(p, F.col("a") > 96, diagonal).collect():
                    got.setdefault(r["page_id"], set()).add((r["comp_id"], r["area"]))
                assert got == {i: _flooded(a[:, :, 3] > 96, diagonal) for i, a in pages.items()}, (most, rows, diagonal)
    finally:
        spark.conf.set(sizes, before)


def test_runs_dealt_by_page_are_labelled_where_they_lie(spark, monkeypatch):
    plans = []
    written = regions.written
    monkeypatch.setattr(regions, "written", lambda df: plans.append(_plan(df)) or written(df))
    p = pixel_table(spark, {1: _page()}).repartition(3, "page_id")
    assert regions.components(p, F.col("a") > 96).count() == 2
    assert len(plans) == 1 and plans[0].count("Exchange") == 1


def test_means_of_squares_leave_pixels_where_they_lie(spark):
    v = np.arange(70 * 30 * 3).reshape(70, 30, 3) * 7919 % 251
    p = pixel_table(spark, {1: v, 2: v[:5, :4]}).repartition(3, "page_id").withColumn("half", F.col("g") / 2)
    got = raster.box_means(p, {"g": "mean", "half": "mean_half"}, 3)
    plan = _plan(got)
    assert "FlatMapGroupsInArrow" not in plan and plan.count("Exchange") == 1
    rows = got.collect()
    assert len(rows) == 70 * 30 + 5 * 4
    for r in rows:
        g = v[:, :, 1] if r["page_id"] == 1 else v[:5, :4, 1]
        want = g[max(0, r["y"] - 3):r["y"] + 4, max(0, r["x"] - 3):r["x"] + 4].mean()
        assert abs(r["mean"] - want) < 1e-9 and abs(r["mean_half"] - want / 2) < 1e-9


def test_the_summary_of_pictures_looks_at_their_pixels_once(spark, monkeypatch):
    cuts, cut = [], gates.cut
    monkeypatch.setattr(gates, "cut", lambda df: cuts.append(df.columns) or cut(df))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.9, 0.3), (3, 0.7, 0.0)], "page_id long, kept double, leak double").mapInArrow(
        counted, "page_id long, kept double, leak double")
    got = gates.kept_leak_summary(rows).first()
    assert tuple(got[c] for c in ("pictures", "kept_min", "kept_median", "leak_max")) == (3, 0.5, 0.7, 0.3)
    assert cuts == [["kept", "leak"]] and seen.value == 3


def test_scans_are_compared_by_windows_as_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pages = {i: rng.integers(0, 256, (70 + i, 90 + 60 * (i % 2), 4)) for i in range(3)}
    scan = pixel_table(spark, pages)
    drawn = pixel_table(spark, {i: np.where(rng.random(a.shape) < 0.3, rng.integers(0, 256, a.shape), a) for i, a in pages.items()})
    made = []
    for most in (2, 0):
        monkeypatch.setattr(gates, "FEW_PADS", most)
        got = gates.scan_check(drawn, scan)
        assert ("FlatMapGroupsInArrow" in _plan(got)) == (most == 0)
        made.append({r["page_id"]: (round(r["iou"], 9), round(r["colour"], 9), r["ok"]) for r in got.collect()})
    assert len(made[0]) == 3 and made[0] == made[1]


def test_signatures_leave_pixels_with_their_page(spark):
    p = pixel_table(spark, {1: _page()}).repartition(3, "page_id")
    b = spark.createDataFrame([(1, 1, 8, 8, 42, 42), (1, 2, 46, 10, 76, 40)], "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = copies.piece_signature(p, b)
    assert "FlatMapGroupsInArrow" not in _plan(got)
    assert {(r["box_id"], r["w"], r["h"], len(r["shape"])) for r in got.collect()} == {(1, 34, 34, 256), (2, 30, 30, 256)}


def test_sheets_are_dealt_over_no_fewer_tasks_than_their_pages(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        assert sheet_pixels(t).rdd.getNumPartitions() == 41
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
