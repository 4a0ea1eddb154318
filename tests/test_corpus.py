import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import copies, raster, tiles
from pagewright.plans import corpus, cutting

from .pages import grid, pixel_table


def _case_sheet():
    """Two squares 12 px apart, a mark under the first and a word of four letters under the second."""
    a = np.zeros((200, 300, 4), int)
    for x0, y0, x1, y1 in [(20, 20, 120, 120), (132, 20, 232, 120), (40, 128, 70, 140)] + [(150 + 14 * i, 128, 158 + 14 * i, 140) for i in range(4)]:
        a[y0:y1, x0:x1] = (30, 30, 30, 255)
    return a


def test_sheet_is_cut_into_its_decals(spark):
    p = pixel_table(spark, {1: _case_sheet()})
    got = cutting.segment_sheet(p, gap=16, min_side=8, pad=0).orderBy("order_no").collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in got] == [(20, 20, 120, 140), (132, 20, 232, 140)]
    assert cutting.segment_sheet(p, gap=0, min_side=6, pad=0).count() == 7


def test_cleaning_a_page(spark):
    page = np.full((120, 160, 3), 250)
    page[30:70, 30:80] = (190, 20, 30)
    page[40:60, 45:65] = 250              # white shut inside: a window of a block
    page[90:92, 100:102] = (225, 226, 225)  # a faint grey speck
    out = grid(corpus.clean_corpus(pixel_table(spark, {1: page})).collect(), "a", (120, 160))
    assert (out[30:70, 30:45] == 255).all() and (out[:25] == 0).all() and (out[90:92, 100:102] == 0).all()
    assert (out[40:60, 45:65] == 0).all()  # half its host's height: a letter's counter at this size


def test_photographs_are_keyed_on_white(spark):
    page = np.full((120, 160, 3), 250)
    page[:8] = page[-8:] = page[:, :8] = page[:, -8:] = (120, 80, 60)  # the table the sheet lies on
    page[40:70, 50:90] = (190, 20, 30)
    p = pixel_table(spark, {1: page, 2: page})
    backing = corpus.page_backing(p)
    kinds = spark.createDataFrame([(1, "photo"), (2, "scan")], "page_id long, kind string")
    keyed = {r["page_id"]: (r["cr"], r["cg"], r["cb"]) for r in corpus.keyed_backing(backing, kinds).collect()}
    assert keyed == {1: (250, 250, 250), 2: (120, 80, 60)}
    out = [r for r in corpus.clean_corpus(p, backing, kinds).collect() if r["page_id"] == 1]
    a = grid(out, "a", (120, 160))
    assert (a[45:65, 55:85] == 255).all() and (a[80:100, 20:140] == 0).all()


def _pages_of_many_kinds():
    """Paper, film, a dark fill, a photo with table along its edge, streaks, holes of three sorts, and no ink at all."""
    rng = np.random.default_rng(5)
    pages = {}
    for i, back in enumerate([(250, 250, 250), (214, 240, 242), (30, 30, 60), (250, 250, 250), (180, 205, 240), (240, 240, 240)]):
        h, w = 88 + i, 121 + 3 * i
        page = np.clip(np.array(back) + rng.integers(-2, 3, (h, w, 1)), 0, 255).repeat(1, 2) + np.zeros((h, w, 3), int)
        for _ in range(6):
            y, x = rng.integers(6, h - 30), rng.integers(6, w - 40)
            dy, dx = rng.integers(8, 24), rng.integers(8, 34)
            page[y:y + dy, x:x + dx] = rng.choice([(0, 0, 0), (255, 255, 255), (200, 20, 30), (20, 40, 180)])
            if dy > 14 and dx > 14:
                page[y + 4:y + dy - 4, x + 4:x + dx - 4] = back
        page[40:70, 20:90] = (10, 10, 10)
        page[48:60, 24:84] = back if i % 2 else (255, 255, 255)
        page[:, 60:62] -= 25 * (i % 3 == 0)
        if i == 3:
            page[:5], page[:, :4] = (90, 60, 40), (90, 60, 40)
        if i == 5:
            page[:, :7] = 255
        pages[i] = np.clip(page, 0, 255)
    pages[9] = np.full((30, 40, 3), 250)
    pages[10] = np.full((3, 2, 3), 200)
    return pages


def test_pages_held_whole_come_out_as_those_cleaned_step_by_step(spark, monkeypatch):
    p = pixel_table(spark, _pages_of_many_kinds())
    backing = corpus.page_backing(p)
    kinds = spark.createDataFrame([(i, {0: "digital", 3: "photo", 4: "photo"}.get(i, "scan")) for i in range(10)], "page_id long, kind string")
    for given, fill in ((None, True), (kinds, True), (kinds, False)):
        made = []
        for most in (1 << 20, 0, 11_000):
            monkeypatch.setattr(tiles, "PAGE_PIXELS", most)
            made.append({tuple(r) for r in corpus.clean_corpus(p, backing, given, dpi=72, fill_holes=fill).collect()})
        assert len(made[0]) == p.count() and made[0] == made[1] == made[2]


def test_streaks_of_pages_held_whole_and_by_windows(spark, monkeypatch):
    p = pixel_table(spark, _pages_of_many_kinds()).drop("a").withColumns({c: F.expr(f"CASE WHEN x % 29 = 13 AND page_id % 2 = 0 THEN {c} - 60 ELSE {c} END") for c in "rgb"})
    want = {tuple(r) for r in raster.destripe_by_windows(p).collect()}
    assert want != {tuple(r) for r in p.collect()}
    for most in (1 << 20, 11_000):
        monkeypatch.setattr(tiles, "PAGE_PIXELS", most)
        assert {tuple(r) for r in raster.destripe(p).collect()} == want
    monkeypatch.setattr(raster, "destripe_by_windows", lambda p: 1 / 0)
    monkeypatch.setattr(tiles, "PAGE_PIXELS", 1 << 20)
    raster.destripe(p)


def test_whole_pages_take_no_steps_of_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "_clean_by_steps", lambda *a: 1 / 0)
    page = np.full((40, 60, 3), 250)
    page[10:30, 10:40] = (190, 20, 30)
    assert corpus.clean_corpus(pixel_table(spark, {1: page})).count() == 2400


def test_incomplete_rasters_are_not_held(spark):
    page = np.full((40, 60, 3), 250)
    p = pixel_table(spark, {1: page, 2: page, 3: page}).filter("NOT (page_id = 2 AND x = 7)")
    p = p.unionAll(p.filter("page_id = 3 AND x = 5")).withColumn("x", F.expr("CASE WHEN page_id = 3 AND x = 6 THEN 60 ELSE x END"))
    assert {r["page_id"]: r["whole"] for r in tiles.page_sizes(p).collect()} == {1: True, 2: False, 3: False}


def test_pages_that_do_not_know_their_resolution(spark):
    page = np.full((90, 120, 3), 250)
    page[30:60, 30:80] = (190, 20, 30)
    p = pixel_table(spark, {1: page, 2: page})
    got = {r["page_id"]: r["native_dpi"] for r in corpus.assess_corpus(p, gap=4, resolutions=spark.createDataFrame([(1, 600)], "page_id long, native_dpi int")).collect()}
    assert got == {1: 600, 2: 300}


def test_census_survives_a_bad_page(spark):
    good = np.zeros((80, 100, 4), int)
    good[..., :3] = 250
    good[20:60, 20:70] = (190, 20, 30, 255)
    p = pixel_table(spark, {1: good, 2: good}).filter("NOT (page_id = 2 AND y = 79)")
    got = {r["page_id"]: r for r in corpus.census_corpus(p).collect()}
    assert got[2]["error"] == "7900 of 8000 pixels" and got[2]["kept"] is None
    assert got[1]["error"] is None and got[1]["kept"] > 0.99 and got[1]["leak"] == 0 and got[1]["decals"] == 1


def test_copies_on_a_sheet(spark):
    rng = np.random.default_rng(8)
    art = np.zeros((40, 60, 4), int)
    art[..., 3] = 255
    art[..., :3] = 60
    art[5:15, 5:40, :3] = 220
    art[20:36, 10:22, :3] = 20
    art[25:30, 40:55] = (200, 30, 30, 255)
    other = np.zeros((40, 60, 4), int)
    other[..., 3] = 255
    other[..., :3] = rng.integers(0, 2, (8, 12, 1)).repeat(5, 0).repeat(5, 1) * 255
    sheet = np.zeros((200, 200, 4), int)
    spots = {1: (10, 10, art), 2: (10, 90, art), 3: (70, 10, art[::-1, ::-1]), 4: (70, 90, art[:, ::-1]), 5: (130, 10, other)}
    boxes = []
    for k, (y, x, pic) in spots.items():
        sheet[y:y + 40, x:x + 60] = pic
        boxes.append((1, k, x, y, x + 60, y + 40))
    p = pixel_table(spark, {1: sheet})
    b = spark.createDataFrame(boxes, "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = copies.copy_groups(copies.piece_signature(p, b), raster.ink_colour(p, b)).collect()
    assert {r["box_id"]: (r["group_id"], r["how"], r["recolour"]) for r in got} == {
        1: (1, "", False), 2: (1, "", False), 3: (1, "turn", False), 4: (1, "mirror", False)}
