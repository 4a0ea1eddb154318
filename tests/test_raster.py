import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import keying, raster, regions
from pagewright.sources import images

from .pages import grid, pixel_table, png


def _brute(a, r, fn):
    h, w = a.shape
    return np.array([[fn(a[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1]) for x in range(w)] for y in range(h)])


def test_neighbourhoods_across_bands(spark):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (150, 23, 3))
    p = pixel_table(spark, {1: rgb}).withColumn("m", F.col("r") > 120)
    mean = grid(raster.box_mean(p, "g", 3, "v").collect(), "v", (150, 23))
    assert np.allclose(mean, _brute(rgb[..., 1], 3, np.mean))
    m = rgb[..., 0] > 60
    p = p.withColumn("m", F.col("r") > 60)
    got = raster.mask_morph(p, "m", 1, {"d": "dilate", "e": "erode", "o": "open"}).collect()
    eroded = _brute(np.pad(m, 1), 1, np.all)[1:-1, 1:-1] & m
    eroded[[0, -1]] = False
    eroded[:, [0, -1]] = False
    assert (grid(got, "d", m.shape) == _brute(m, 1, np.any)).all()
    assert (grid(got, "e", m.shape) == eroded).all()
    assert (grid(got, "o", m.shape) == _brute(eroded, 1, np.any)).all()
    rank = grid(raster.square_rank(p, "b", 1, "mMMm", "v").collect(), "v", m.shape)
    want = rgb[..., 2]
    for fn in (np.min, np.max, np.max, np.min):
        want = _brute(want, 1, fn)
    assert (rank == want).all()


def test_regions_of_a_spiral_and_of_specks(spark):
    n = 41
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx, run = 0, 1, n
    m[0, 0] = True
    while run > 2:                      # one long winding stroke
        for _ in range(run - 1):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
        run -= 1
    rgba = np.zeros((n, n, 4), int)
    rgba[..., 3] = m * 255
    specks = np.zeros((30, 30, 4), int)
    specks[::3, ::3, 3] = 255
    diag = np.zeros((8, 8, 4), int)
    diag[np.arange(8), np.arange(8), 3] = 255
    p = pixel_table(spark, {1: rgba, 2: specks, 3: diag})
    c = regions.components(p, F.col("a") > 96).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("area").alias("area")).collect()
    got = {r["page_id"]: (r["n"], r["area"]) for r in c}
    assert got[2] == (100, 100) and got[3] == (1, 8) and got[1][1] == m.sum()
    four = regions.components(p.filter("page_id = 3"), F.col("a") > 96, diagonal=False)
    assert four.count() == 8


def _flood(m, diagonal):
    lab = np.zeros(m.shape, int)
    k = 0
    for sy, sx in zip(*np.nonzero(m)):
        if lab[sy, sx]:
            continue
        k += 1
        stack = [(sy, sx)]
        lab[sy, sx] = k
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy and dx and not diagonal) or not (0 <= y + dy < m.shape[0] and 0 <= x + dx < m.shape[1]):
                        continue
                    if m[y + dy, x + dx] and not lab[y + dy, x + dx]:
                        lab[y + dy, x + dx] = k
                        stack.append((y + dy, x + dx))
    return lab


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_against_a_flood_fill(spark, diagonal):
    rng = np.random.default_rng(4)
    pages = {}
    for i in range(3):
        a = np.zeros((60, 130, 4), int)
        a[..., 3] = (rng.random((60, 130)) < 0.35 + 0.1 * i) * 255
        pages[i] = a
    got = regions.components(pixel_table(spark, pages), F.col("a") > 96, diagonal).collect()
    for i, a in pages.items():
        lab = _flood(a[..., 3] > 96, diagonal)
        want = sorted(((np.nonzero(lab == k)[1].min(), np.nonzero(lab == k)[0].min(), int((lab == k).sum())) for k in range(1, lab.max() + 1)))
        assert sorted((r["x0"], r["y0"], r["area"]) for r in got if r["page_id"] == i) == want


def test_holes_windows_and_counters(spark):
    a = np.zeros((120, 220, 4), int)
    a[..., :3] = 250
    a[10:110, 10:110] = (20, 20, 20, 255)
    a[30:48, 30:48, 3] = 0                 # a window in a big block
    a[80:83, 80:83, 3] = 0                 # a speck
    a[20:60, 130:170] = (20, 20, 20, 255)
    a[30:50, 140:160, 3] = 0               # a letter's counter
    a[90:110, 130:150] = (20, 20, 20, 255)
    a[95:120, 135:140, 3] = 0              # open to the outside
    got = {(r["x0"], r["y0"]): r["why"] for r in regions.enclosed_holes(pixel_table(spark, {1: a})).collect()}
    assert got == {(30, 30): "white ink", (80, 80): "speck", (140, 30): "counter"}
    holes = regions.enclosed_holes(pixel_table(spark, {1: a}))
    filled = keying.fill_holes(pixel_table(spark, {1: a}), regions.hole_runs(pixel_table(spark, {1: a}), holes))
    al = grid(filled.collect(), "a", (120, 220))
    assert (al[30:48, 30:48] == 255).all() and (al[30:50, 140:160] == 0).all() and (al[80:83, 80:83] == 0).all()


def test_palette_and_backdrop(spark):
    a = np.zeros((40, 60, 4), int)
    a[..., 3] = 255
    a[:, :30, :3] = (200, 20, 30)
    a[:, 30:55, :3] = (228, 236, 230)      # film-tinted white ink
    a[:, 55:, :3] = (210, 28, 36)          # a noise shade of the red
    boxes = spark.createDataFrame([(1, 1, 0, 0, 60, 40)], "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = raster.palette_census(pixel_table(spark, {1: a}), boxes).orderBy("rank").collect()
    assert [(r["r"], r["g"], r["b"]) for r in got] == [(200, 20, 30), (255, 255, 255)]
    mode = raster.backdrop_mode(pixel_table(spark, {1: a})).first()
    assert (mode["r"], mode["g"], mode["b"]) == (200, 20, 30) and mode["share"] > 0.35


def test_tinted_film_keeps_white_ink(spark):
    a = np.zeros((90, 90, 3), int)
    a[:] = (214, 240, 242)
    a[20:50, 20:50] = (248, 250, 249)
    a[60:80, 60:80] = (180, 20, 30)
    p = pixel_table(spark, {1: a})
    carrier = raster.border_median(p).withColumnsRenamed({"r": "cr", "g": "cg", "b": "cb"})
    al = grid(keying.carrier_alpha(p, carrier).collect(), "a", (90, 90))
    assert (al[:15] == 0).all() and (al[24:46, 24:46] == 255).all() and (al[60:80, 60:80] == 255).all()


def test_pictures_from_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    pics = {"a": rng.integers(0, 256, (5, 7, 4)), "b": rng.integers(0, 256, (300, 260, 3))}
    for k, v in pics.items():
        (tmp_path / f"{k}.png").write_bytes(png(v))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    dpi = spark.createDataFrame([("a", 300), ("b", 96)], "label string, dpi int")
    rows = images.pixels_of(images.read_images(spark, str(tmp_path)), dpi).toPandas()
    assert set(rows["label"]) == {"a", "b"}
    for k, v in pics.items():
        got = rows[rows["label"] == k].sort_values(["y", "x"])
        assert (got[["r", "g", "b"]].to_numpy() == v[..., :3].reshape(-1, 3)).all()
        assert (got["width"] == v.shape[1]).all() and len(got) == v.shape[0] * v.shape[1]
    assert rows[rows["label"] == "a"]["dpi"].eq(300).all() and rows[rows["label"] == "b"]["dpi"].isna().all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sheets_are_drawn_by_many_tasks(spark):
    from pagewright.checks.registry import Tables
    from pagewright.checks.sheets import sheet_pixels

    assert sheet_pixels(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("key", ["kept_leak", "coverage", "scan_check"])
def test_pixels_are_not_broadcast(spark, key):
    from __spark_entry__ import queries

    assert "BroadcastHashJoin" not in _plan(queries()[key](spark, "/root/testdata/sf0.001"))


def test_pixels_of_crowded_pages_find_their_boxes(spark):
    n = raster.FEW_BOXES + 3
    pixels = spark.range(40).selectExpr("id div 20 + 1 AS page_id", "0 AS y", "cast(id % 20 AS int) AS x")
    boxes = spark.createDataFrame([(1, i, i % 19, 0, i % 19 + 2, 1) for i in range(n)] + [(2, 0, 3, 0, 6, 1)],
                                  "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.page_id, r.box_id, r.x) for r in raster.pixels_in_boxes(pixels, boxes).collect())
    assert got == sorted([(1, i, i % 19 + d) for i in range(n) for d in (0, 1)] + [(2, 0, x) for x in (3, 4, 5)])
