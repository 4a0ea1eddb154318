from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import boxes as B
from pagewright.operators import copies as C
from pagewright.operators import regions


def test_bad_page_list_is_rejected(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2)], "job_id int, page_no int")
    for spec in ("x", "0", "3-2", "1-", "2-3-4"):
        with pytest.raises(Exception, match="not a page list"):
            B.page_select(pages, spark.createDataFrame([(1, spec)], "job_id int, spec string")).collect()


@pytest.mark.parametrize("w,h,dpi,want", [(1200, 600, 600, (600, 300, 300)), (1200, 600, 300, (1200, 600, 300)), (1000, 10, 315, (1000, 10, 315))])
def test_working_size(spark, w, h, dpi, want):
    row = spark.createDataFrame([(w, h, dpi, None, 1.35, "1/12 — 6\" Classified", "1/6 — 12\" figure")],
                                "width int, height int, dpi int, width_mm double, gap_mm double, source_scale string, target_scale string")
    r = B.page_geometry(row).first()
    assert (r["work_width"], r["work_height"], r["work_dpi"]) == want and r["scale"] == 2.0
    assert r["gap_px"] == 16 if want[2] == 300 else True


def _layout(spark, sizes, paper=(8.5, 11)):
    df = spark.createDataFrame([(1, i, float(w), float(h)) for i, (w, h) in enumerate(sizes)], "job_id int, piece_id int, w_in double, h_in double")
    return B.shelf_layout(B.tile_split(df, paper[0] - 0.8, paper[1] - 0.8), paper).orderBy("piece_id", "part").collect()


def test_print_pages(spark):
    six = _layout(spark, [(2, 1)] * 6)
    assert {r["page_no"] for r in six} == {1}
    assert [round(r["y_in"], 2) for r in six] == [0.4] * 3 + [1.52] * 3
    assert {r["page_no"] for r in _layout(spark, [(3, 2)] * 16)} == {1, 2}
    tiled = _layout(spark, [(12, 3)])
    assert [r["tile"] for r in tiled] == [f"part {i} of 2 (row 1, column {i}; 0.20 in overlap)" for i in (1, 2)]
    with pytest.raises(ValueError):
        _layout(spark, [(1, 1)], paper=(1.0, 1.0))


def test_near_pairs_against_brute_force(spark):
    rows = [(i % 3, i, (i * 37) % 300 - 20, (i * 91) % 280, (i * 37) % 300 - 20 + 5 + i % 90, (i * 91) % 280 + 3 + i % 70) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    near = lambda a, b, g: a[2] - g <= b[4] and b[2] - g <= a[4] and a[3] - g <= b[5] and b[3] - g <= a[5]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and near(a, b, 9)}
    got = [tuple(r) for r in B.box_near_join(df, 9, cell=32).collect()]
    assert set(got) == want and len(got) == len(want)


def test_words_and_graphics_group_by_size(spark):
    # two big boxes 12 px apart stay apart, a mark joins the nearer, letters become one word beside it
    rows = [(1, 1, 0, 0, 100, 100), (1, 2, 112, 0, 212, 100), (1, 3, 20, 108, 50, 120)] + [(1, 10 + i, 120 + 10 * i, 108, 128 + 10 * i, 120) for i in range(4)]
    got = regions.group_boxes(spark.createDataFrame(rows, "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int"), gap=16).orderBy("x0").collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["pieces"]) for r in got] == [(0, 0, 100, 120, 2), (112, 0, 212, 120, 5)]


def test_grouping_is_the_same_for_a_spot_printed_often(spark):
    rows = [(1, i, 5, 5, 15, 15) for i in range(500)] + [(1, 900, 18, 5, 30, 15)]
    got = regions.group_boxes(spark.createDataFrame(rows, "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int"), gap=4).collect()
    assert [(r["x0"], r["x1"], r["pieces"]) for r in got] == [(5, 30, 501)]


def test_text_rows(spark):
    letters = [(1, i, 10 + 14 * i, 20 + i % 2, 20 + 14 * i, 36, 90, 0.0, 0.0, 0.0) for i in range(6)]
    bar = [(2, 50, 0, 0, 200, 40, 8000, 0.0, 0.0, 0.0)]
    red = [(1, 40, 100, 20, 112, 36, 10, 255.0, 0.0, 0.0)]
    df = spark.createDataFrame(letters + bar + red, "page_id int, piece_id int, x0 int, y0 int, x1 int, y1 int, area int, r double, g double, b double")
    got = {r["page_id"]: r for r in B.text_rows(df, df.groupBy("page_id").agg(F.sum("area").alias("total"))).collect()}
    assert got[1]["text"] and got[1]["lines"] == 1 and got[1]["letter_px"] == 16
    assert got[1]["share"] == pytest.approx(540 / 550) and not got[2]["text"]


def test_reading_order_equals_the_walk(spark):
    import random

    rnd = random.Random(11)
    rows = []
    for p in (1, 2):
        for i in range(150):
            x, y = rnd.randint(0, 900), rnd.randint(0, 2500)
            rows.append((p, i, x, y, x + rnd.randint(5, 80), y + rnd.randint(5, 40)))
    df = spark.createDataFrame(rows, "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    want = {}
    for p in (1, 2):
        n = top = low = 0
        placed = []
        for _, i, x0, y0, _, y1 in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[2], r[1])):
            if n and min(low, y1) - max(top, y0) > 0.4 * min(y1 - y0, low - top):
                top, low = min(top, y0), max(low, y1)
            else:
                n, top, low = n + 1, y0, y1
            placed.append((n, x0, y0, i))
        want |= {(p, i): (n, k) for k, (n, _, _, i) in enumerate(sorted(placed), 1)}
    assert {(r["page_id"], r["box_id"]): (r["row_no"], r["order_no"]) for r in B.reading_order(df).collect()} == want


def test_page_numbers_of_any_length(spark):
    specs = [("99999999999999999999",), ("2-99999999999999999999",), ("99999999999999999999-99999999999999999998",), ("0002",), ("0",)]
    ranges, bad = B.parse_pages(F.col("spec"))
    got = {r["spec"]: (r["bad"], r["r"]) for r in spark.createDataFrame(specs, "spec string").select("spec", bad.alias("bad"), ranges.alias("r")).collect()}
    assert [got[s[0]][0] for s in specs] == [False, False, True, False, True]
    assert tuple(got["0002"][1][0]) == (2, 2)


def test_strict_page_lists_fail(spark):
    pages = spark.createDataFrame([(1, 1)], "job_id int, page_no int")
    jobs = spark.createDataFrame([(1, "4-2")], "job_id int, spec string")
    with pytest.raises(Exception, match="not a page list"):
        B.page_select(pages, jobs).collect()


def test_owner_prefers_the_smallest_whole_box(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 200, 200), (1, 2, 50, 50, 90, 90)], "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    pieces = spark.createDataFrame([(1, 7, 55, 55, 80, 80), (1, 8, 10, 10, 20, 20), (1, 9, 190, 190, 400, 400)],
                                   "page_id int, piece_id int, x0 int, y0 int, x1 int, y1 int")
    assert {r["piece_id"]: (r["box_id"], r["whole"]) for r in B.box_owner(pieces, boxes).collect()} == {7: (2, True), 8: (1, True), 9: (1, False)}


def test_leader_rule_is_not_transitive(spark):
    # b is like a and c is like b, but c is not like a: c leads its own group
    rows = [(1, 1, 40, 40, 0.0), (1, 2, 41, 40, 1.0), (1, 3, 40, 41, 2.0), (1, 4, 90, 90, 0.0), (1, 5, 40, 40, 2.5)]
    items = spark.createDataFrame(rows, "page_id int, box_id int, w int, h int, v double")
    match = lambda a, b: F.struct(F.lit(1.0).alias("score"), F.when(F.abs(F.col(f"{a}.v") - F.col(f"{b}.v")) <= 1, "").alias("how"))
    got = {r["box_id"]: r["leader"] for r in C.leader_groups(items, match).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_leader_rule_against_the_plain_walk(spark):
    import random

    rnd = random.Random(5)
    rows = [(p, i, rnd.randint(30, 60), rnd.randint(30, 60), rnd.uniform(0, 6)) for p in (1, 2) for i in range(60)]
    tol = B.SIZE_TOLERANCE
    fits = lambda a, b, c, d: abs(a - c) <= tol * max(a, c) and abs(b - d) <= tol * max(b, d)
    want = {}
    for p in (1, 2):
        mine = [r for r in rows if r[0] == p]
        for a in mine:
            if (p, a[1]) in want:
                continue
            want[(p, a[1])] = a[1]
            for b in mine:
                if b[1] > a[1] and (p, b[1]) not in want and (fits(a[2], a[3], b[2], b[3]) or fits(a[2], a[3], b[3], b[2])) and abs(a[4] - b[4]) <= 1.5:
                    want[(p, b[1])] = a[1]
    items = spark.createDataFrame(rows, "page_id int, box_id int, w int, h int, v double")
    match = lambda a, b: F.struct(F.lit(1.0).alias("score"), F.when(F.abs(F.col(f"{a}.v") - F.col(f"{b}.v")) <= 1.5, "").alias("how"))
    got = {(r["page_id"], r["box_id"]): r["leader"] for r in C.leader_groups(items, match).collect()}
    assert got == want


def test_orientations_compose(spark):
    import numpy as np

    names = list(C.ORIENTATIONS)
    pairs = spark.createDataFrame([(o, i) for o in names for i in names], "o string, i string")
    for r in pairs.withColumn("c", C.compose_orientation(F.col("o"), F.col("i"))).collect():
        m = lambda k: np.array(C.ORIENTATIONS[k]).reshape(2, 2)
        assert (m(r["c"]) == m(r["o"]) @ m(r["i"])).all()


def test_a_half_of_exactly_a_fifth_counts(spark):
    """Two halves in the proportion 1 : 4, for which 0.2 * w * h in doubles lies above the whole number."""
    rows = [(1, 1, 0, 0, 6, 1), (1, 2, 0, 1, 6, 5), (1, 3, 100, 100, 106, 105)]
    b = spark.createDataFrame(rows, "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    assert [(r.box_a, r.box_b, r["like"]) for r in B.split_halves(b, 1).collect()] == [(1, 2, 3)]


def test_identical_big_pieces_stay_apart_from_words(spark):
    rows = [(1, i, 0, 0, 90, 90) for i in (1, 2)] + [(1, i, 300, 0, 310, 10) for i in (3, 4)]
    p = spark.createDataFrame(rows, "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.item, r.pieces) for r in regions.group_words(p, 20).collect())
    assert got == [(1, 1), (2, 1), (3, 2)]


def test_near_pairs_of_few_and_of_many_boxes(spark):
    rows = [(p, i, (i * 37) % 300, (i * 53) % 200, (i * 37) % 300 + 9, (i * 53) % 200 + 9) for p, n in ((1, 20), (2, 60), (3, 1)) for i in range(n)]
    b = spark.createDataFrame(rows, "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    want = {(p, i, j) for p, i, a, c, d, e in rows for q, j, f, g, h, k in rows
            if p == q and i < j and a - 12 <= h and f - 12 <= d and c - 12 <= k and g - 12 <= e}
    assert {(r.page_id, r.box_a, r.box_b) for r in B.box_near_join(b, 12).collect()} == want


def test_sheet_of_many_pieces_is_composed_like_one_of_few(spark):
    n = C.raster.FEW_BOXES + 5
    boxes = spark.createDataFrame([(1, i, 2 * i, 0, 2 * i + 3, 1) for i in range(n)] + [(2, i, 2 * i, 0, 2 * i + 3, 1) for i in range(4)],
                                  "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    parts = boxes.selectExpr("page_id", "box_id", "0 AS y", "explode(sequence(0, 2)) AS x", "box_id AS r", "1 AS g", "2 AS b", "255 AS a")
    got = C.sheet_compose(parts, boxes)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.page_id, r.x): (r.box_id, r.r) for r in got.collect()}
    assert rows == {(p, 2 * i + d): (i, i) if d < 2 or i == last else (i + 1, i + 1) for p, last in ((1, n - 1), (2, 3)) for i in range(last + 1) for d in (0, 1, 2)}


def test_sheets_held_whole_are_composed_like_those_of_rows(spark, monkeypatch):
    from pagewright.checks import copies as checks

    rng = np.random.default_rng(4)
    rows = [(p, i, int(x), int(y), int(x + w), int(y + h)) for p in range(40) for i in range(7) for x, y, w, h in [rng.integers(0, (40, 40, 25, 25))]]
    rows += [(50, i, 0, 0, 9, 9) for i in range(3)] + [(60, 1, 0, 0, 1, 1), (70, 1, 0, 0, 4, 4), (70, 2, 90_000, 90_000, 90_004, 90_004), (80, 1, 5, 5, 5, 9)]
    b = spark.createDataFrame(rows, "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")

    class Tables:
        lineitem = b.withColumnRenamed("page_id", "l_orderkey")

    Tables.spark = spark
    want = {tuple(r) for r in checks._composed_by_rows(Tables, b).collect()}
    for most, once in ((1 << 22, 1 << 18), (1 << 22, 300), (500, 300)):
        monkeypatch.setattr(C, "PAGE_INK", most)
        monkeypatch.setattr(C, "INK_AT_ONCE", once)
        few, many = C.by_ink(b)
        got = C.compose_held(few, checks._drawn, checks._sums, "pixels bigint, by_x bigint, by_y bigint", 0.5)
        assert (many.count() > 0) == (most == 500)
        assert {tuple(r) for r in got.unionByName(checks._composed_by_rows(Tables, many)).collect()} == want


def test_order_lines_are_dealt_by_number(spark, monkeypatch):
    """Boxes, attempts, files and members come from order lines: a task gets so many lines, not so many compressed bytes of them."""
    from pagewright.checks import boxes as drawn
    from pagewright.checks import copies, registry, store  # noqa: F401

    monkeypatch.setattr(registry, "LINES_A_TASK", 250, raising=False)
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    want = -(-t.lineitem.count() // 250)
    assert drawn.boxes(t).rdd.getNumPartitions() >= want
    seen = []
    for module, name in ((store, "sample_per_folder"), (copies, "group_representative")):
        operator = getattr(module.ops, name)
        monkeypatch.setattr(module.ops, name, lambda df, *a, go=operator: seen.append(df.rdd.getNumPartitions()) or go(df, *a))
        registry.QUERIES[name](spark, t.dir)
    assert len(seen) == 2 and min(seen) >= want


def test_pages_of_few_and_of_many_boxes_are_read_alike(spark, monkeypatch):
    """Pages that fit a task take one pass; crowded ones go by slices, with the same rows and places."""
    import random

    rnd = random.Random(5)
    rows = [(p, i, rnd.randint(0, 40) * 10, rnd.randint(0, 200) * 10) for p, n in ((1, 6), (2, 150), (5, 170), (3, 1), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x0 int, y0 int").selectExpr("*", "x0 + 5 + box_id % 50 AS x1", "y0 + 6 + box_id % 17 AS y1")
    pieces = df.withColumnRenamed("box_id", "piece_id").selectExpr(
        "*", "cast((x1 - x0) * (y1 - y0) * 0.7 AS bigint) AS area", *[f"cast(piece_id % 3 * 60 AS double) AS {c}" for c in "rgb"])
    ink = pieces.groupBy("page_id").agg(F.sum("area").alias("total"))
    got = []
    for most in (4096, 100):
        monkeypatch.setattr(B, "PAGE_ROWS", most, raising=False)
        got.append([Counter(map(tuple, d.collect())) for d in (B.reading_order(df), B.text_rows(pieces, ink))])
    assert got[0] == got[1] and sum(got[0][0].values()) == len(rows)


def test_reading_order_moves_boxes_of_small_pages_once(spark):
    df = spark.range(2000).selectExpr("id div 4 AS page_id", "id AS box_id", "id % 7 AS x0", "id % 5 AS y0", "id % 7 + 9 AS x1", "id % 5 + 9 AS y1")
    plan = B.reading_order(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
