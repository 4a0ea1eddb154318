"""Box checks: one page per order, one box per order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as ops
from .registry import Tables, check

BOXES = """
boxes AS (SELECT l_orderkey AS page_id, l_linenumber AS box_id, (min(l_partkey % 40) * 12)::INT AS x0, (min(l_suppkey % 30) * 12)::INT AS y0,
  (min(l_partkey % 40) * 12)::INT + 4 + max(l_quantity)::INT AS x1, (min(l_suppkey % 30) * 12)::INT + 4 + min(l_quantity)::INT AS y1
  FROM lineitem GROUP BY ALL)"""


def boxes(t: Tables):
    # dealt by page, as whatever is done with the boxes of a page wants them
    return t.lines("l_orderkey").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("box_id")).agg(
        (F.min(F.col("l_partkey") % 40) * 12).cast("int").alias("x0"), (F.min(F.col("l_suppkey") % 30) * 12).cast("int").alias("y0"),
        F.max("l_quantity").cast("int").alias("_w"), F.min("l_quantity").cast("int").alias("_h"),
    ).select("page_id", "box_id", "x0", "y0", (F.col("x0") + 4 + F.col("_w")).alias("x1"), (F.col("y0") + 4 + F.col("_h")).alias("y1"))


@check("page_select", """
WITH jobs AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 6 WHEN 0 THEN 'all' WHEN 1 THEN '2' WHEN 2 THEN '1, 3' WHEN 3 THEN '2-4;7'
   WHEN 4 THEN '4-2' ELSE ' * ' END AS spec FROM orders),
pages AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS page_no FROM lineitem)
SELECT job_id, page_no FROM pages JOIN jobs USING (job_id)
WHERE spec IN ('all', ' * ') OR (spec = '2' AND page_no = 2) OR (spec = '1, 3' AND page_no IN (1, 3))
   OR (spec = '2-4;7' AND page_no IN (2, 3, 4, 7))""")
def _(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), F.expr(
        """CASE o_orderkey % 6 WHEN 0 THEN 'all' WHEN 1 THEN '2' WHEN 2 THEN '1, 3' WHEN 3 THEN '2-4;7' WHEN 4 THEN '4-2'
           ELSE ' * ' END""").alias("spec"))
    pages = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_no")).distinct()
    return ops.page_select(pages, jobs, strict=False)


_NAMES = list(ops.SCALE_PRESETS)
_SPARK_NAMES = "array(" + ", ".join("'" + n.replace("'", "\\'") + "'" for n in _NAMES) + ")"
_NUMBERS = "[" + ", ".join(str(n) for n in ops.SCALE_PRESETS.values()) + "]"


@check("page_geometry", f"""
WITH p AS (SELECT p_partkey AS page_id, (p_size * 97 + 40)::INT AS width, (p_size * 61 + 30)::INT AS height,
   CASE p_partkey % 4 WHEN 0 THEN 600.0 WHEN 1 THEN 300.0 WHEN 2 THEN 150.0 END::DOUBLE AS dpi, CASE WHEN p_partkey % 8 = 3 THEN 210.0 END::DOUBLE AS width_mm,
   (p_partkey % 5) * 0.7::DOUBLE AS gap_mm,
   {_NUMBERS}[p_partkey % 9 + 1] AS s, {_NUMBERS}[p_size % 8 + 1] AS g FROM part),
n AS (SELECT *, coalesce(dpi, CASE WHEN width_mm > 0 THEN width / (width_mm / 25.4) END, 300.0) AS native FROM p),
w AS (SELECT *, native > 315 AS fine, CASE WHEN native > 315 THEN 300.0 ELSE native END AS wd FROM n)
SELECT page_id, CASE WHEN fine THEN greatest(1, round_even(width * (300 / native), 0)::INT) ELSE width END AS work_width,
  CASE WHEN fine THEN greatest(1, round_even(height * (300 / native), 0)::INT) ELSE height END AS work_height, round(wd, 6) AS work_dpi,
  greatest(round_even(gap_mm / 25.4 * wd, 0), round_even(16 * wd / 300.0, 0))::INT AS gap_px,
  round(coalesce(s / g, 1.0), 6) AS scale, round(width / native * coalesce(s / g, 1.0), 6) AS w_in, round(height / native * coalesce(s / g, 1.0), 6) AS h_in
FROM w""")
def _(t):
    p = t.part.select(
        F.col("p_partkey").alias("page_id"), F.expr("p_size * 97 + 40").alias("width"), F.expr("p_size * 61 + 30").alias("height"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 600.0D WHEN 1 THEN 300.0D WHEN 2 THEN 150.0D END").alias("dpi"),
        F.expr("CASE WHEN p_partkey % 8 = 3 THEN 210.0D END").alias("width_mm"), F.expr("(p_partkey % 5) * 0.7D").alias("gap_mm"),
        F.expr(f"try_element_at({_SPARK_NAMES}, cast(p_partkey % 9 + 1 AS int))").alias("source_scale"),
        F.expr(f"try_element_at({_SPARK_NAMES}, cast(p_size % 8 + 1 AS int))").alias("target_scale"))
    out = ops.page_geometry(p)
    return out.select("page_id", "work_width", "work_height", "gap_px",
                      *[F.round(c, 6).alias(c) for c in ("work_dpi", "scale", "w_in", "h_in")])


NEAR = "a.x0 - {g} <= b.x1 AND b.x0 - {g} <= a.x1 AND a.y0 - {g} <= b.y1 AND b.y0 - {g} <= a.y1"


@check("box_near_join", f"""WITH {BOXES}
SELECT a.page_id, a.box_id AS box_a, b.box_id AS box_b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id
WHERE {NEAR.format(g=16)}""")
def _(t):
    return ops.box_near_join(boxes(t), gap=16)


@check("box_owner", f"""WITH {BOXES},
pieces AS (SELECT page_id, box_id * 10 AS piece_id, x0 + 2 AS x0, y0 + 2 AS y0, x0 + 6 + (x1 - x0) // 3 AS x1, y0 + 5 + (y1 - y0) // 3 AS y1 FROM boxes
           UNION ALL SELECT page_id, box_id * 10 + 1, x0 - 9, y0 - 9, x0 + 9, y0 + 9 FROM boxes),
j AS (SELECT p.page_id, p.piece_id, b.box_id, least(p.x1, b.x1) - greatest(p.x0, b.x0) AS ix, least(p.y1, b.y1) - greatest(p.y0, b.y0) AS iy,
  b.x0 <= p.x0 + 4 AND b.y0 <= p.y0 + 4 AND p.x1 - 4 <= b.x1 AND p.y1 - 4 <= b.y1 AS whole, (b.x1 - b.x0) * (b.y1 - b.y0) AS area
  FROM pieces p JOIN boxes b USING (page_id))
SELECT page_id, piece_id, box_id, whole FROM j WHERE ix > 0 AND iy > 0
QUALIFY row_number() OVER (PARTITION BY page_id, piece_id ORDER BY whole DESC, CASE WHEN whole THEN area ELSE -ix * iy END, box_id) = 1""")
def _(t):
    b = boxes(t)
    pieces = b.selectExpr("page_id", "box_id * 10 AS piece_id", "x0 + 2 AS x0", "y0 + 2 AS y0",
                          "cast(x0 + 6 + (x1 - x0) div 3 AS int) AS x1", "cast(y0 + 5 + (y1 - y0) div 3 AS int) AS y1").unionByName(
        b.selectExpr("page_id", "box_id * 10 + 1 AS piece_id", "x0 - 9 AS x0", "y0 - 9 AS y0", "x0 + 9 AS x1", "y0 + 9 AS y1"))
    return ops.box_owner(pieces, b)


def _fits(aw, ah, bw, bh, tol):
    return f"(abs({aw} - {bw}) <= {tol} * greatest({aw}, {bw}) AND abs({ah} - {bh}) <= {tol} * greatest({ah}, {bh}))"


@check("size_match_join", f"""WITH {BOXES},
s AS (SELECT page_id, box_id, x1 - x0 AS w, y1 - y0 AS h FROM boxes),
p AS (SELECT a.page_id, a.box_id AS ia, b.box_id AS ib, a.w, a.h, b.w AS w2, b.h AS h2,
  {_fits('a.w', 'a.h', 'b.w', 'b.h', 0.06)} AS same, {_fits('a.w', 'a.h', 'b.h', 'b.w', 0.06)} AS quarter
  FROM s a JOIN s b ON a.page_id = b.page_id AND a.box_id <> b.box_id
  WHERE (a.w, a.h) < (b.w, b.h) OR (a.w = b.w AND a.h = b.h AND a.box_id < b.box_id))
SELECT page_id, w, h, w2, h2, same, quarter, min(ia) AS first_a, min(least(ib, CASE WHEN w = w2 AND h = h2 THEN ia ELSE ib END)) AS first_b, count(*) AS n_pairs
FROM p WHERE same OR quarter GROUP BY ALL""")
def _(t):
    return ops.size_match_join(boxes(t))


@check("split_halves", f"""WITH {BOXES},
j AS (SELECT a.page_id, a.box_id AS box_a, b.box_id AS box_b, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0,
   greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1,
   least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS least_area
 FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id
 WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.5 * least(a.x1 - a.x0, b.x1 - b.x0) AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 48)
    OR (least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 48)),
u AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM j WHERE least_area >= 0.2 * (x1 - x0) * (y1 - y0))
SELECT u.page_id, box_a, box_b, u.x0, u.y0, u.x1, u.y1, min(c.box_id) AS "like" FROM u
JOIN (SELECT page_id, box_id, x1 - x0 AS cw, y1 - y0 AS ch FROM boxes) c ON c.page_id = u.page_id AND c.box_id NOT IN (box_a, box_b)
WHERE {_fits('cw', 'ch', 'w', 'h', 0.08)} OR {_fits('cw', 'ch', 'h', 'w', 0.08)} GROUP BY ALL""")
def _(t):
    return ops.split_halves(boxes(t), gap=16)


@check("letter_size", f"""WITH {BOXES},
s AS (SELECT page_id // 8 AS page_id, least(x1 - x0, y1 - y0) AS small, greatest(x1 - x0, y1 - y0) AS big FROM boxes)
SELECT page_id, count(*) FILTER (small >= 9 AND big <= 90 AND big <= 4 * small) AS letters,
  CASE WHEN count(*) FILTER (small >= 9 AND big <= 90 AND big <= 4 * small) >= 5
       THEN median(small) FILTER (small >= 9 AND big <= 90 AND big <= 4 * small) END::DOUBLE AS letters_px FROM s GROUP BY page_id""")
def _(t):
    return ops.letter_size(boxes(t).withColumn("page_id", F.expr("page_id div 8")))


@check("reading_order", f"""WITH RECURSIVE {BOXES},
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS i FROM boxes),
walk AS (SELECT page_id, box_id, x0, y0, i, 1 AS row_no, y0 AS top, y1 AS low FROM s WHERE i = 1
  UNION ALL
  SELECT s.page_id, s.box_id, s.x0, s.y0, s.i, CASE WHEN fits THEN row_no ELSE row_no + 1 END,
     CASE WHEN fits THEN least(top, s.y0) ELSE s.y0 END, CASE WHEN fits THEN greatest(low, s.y1) ELSE s.y1 END
  FROM walk w JOIN s ON s.page_id = w.page_id AND s.i = w.i + 1,
  LATERAL (SELECT least(w.low, s.y1) - greatest(w.top, s.y0) > 0.4 * least(s.y1 - s.y0, w.low - w.top) AS fits))
SELECT page_id, box_id, row_no, row_number() OVER (PARTITION BY page_id ORDER BY row_no, x0, y0, box_id)::INT AS order_no FROM walk""")
def _(t):
    return ops.reading_order(boxes(t)).select("page_id", "box_id", "row_no", "order_no")


PIECES = """
pieces AS (SELECT l_orderkey // 20 AS job_id, l_orderkey * 10 + l_linenumber AS piece_id, 0.5 + max(l_quantity) / 5.0 AS w_in, 0.5 + min(l_quantity) / 10.0 AS h_in
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
grid AS (SELECT *, w_in > 7.7 + 1e-6 OR h_in > 10.2 + 1e-6 AS big FROM pieces),
cnt AS (SELECT *, CASE WHEN big THEN greatest(1, ceil((w_in - 0.2) / 7.5))::INT ELSE 1 END AS nx, CASE WHEN big THEN greatest(1, ceil((h_in - 0.2) / 10.0))::INT ELSE 1 END AS ny FROM grid),
til AS (SELECT c.*, r.r, k.k FROM cnt c, LATERAL (SELECT unnest(range(ny)) AS r) r, LATERAL (SELECT unnest(range(nx)) AS k) k),
tiles AS (SELECT job_id, piece_id, (r * nx + k + 1)::INT AS part,
  CASE WHEN big THEN 'part ' || (r * nx + k + 1) || ' of ' || nx * ny || ' (row ' || r + 1 || ', column ' || k + 1 || '; 0.20 in overlap)' ELSE '' END AS tile,
  CASE WHEN big THEN least(w_in, k * 7.5 + 7.7) - k * 7.5 ELSE w_in END AS tile_w, CASE WHEN big THEN least(h_in, r * 10.0 + 10.2) - r * 10.0 ELSE h_in END AS tile_h FROM til)"""


def _tiles(t: Tables):
    p = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.min("l_quantity").alias("s")).select(
        F.expr("l_orderkey div 20").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("piece_id"),
        (F.lit(0.5) + F.col("q") / 5.0).alias("w_in"), (F.lit(0.5) + F.col("s") / 10.0).alias("h_in"))
    return ops.tile_split(p, 8.5 - 0.8, 11 - 0.8)


@check("tile_split", f"WITH {PIECES} SELECT job_id, piece_id, part, tile, round(tile_w, 6) AS tile_w, round(tile_h, 6) AS tile_h FROM tiles")
def _(t):
    return _tiles(t).withColumn("tile_w", F.round("tile_w", 6)).withColumn("tile_h", F.round("tile_h", 6))


@check("shelf_layout", f"""WITH RECURSIVE {PIECES},
s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tile_h DESC, piece_id, part) AS i FROM tiles),
walk AS (
  SELECT job_id, piece_id, part, i, 1 AS page_no, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, tile_w + 0.12 AS x, 0.0::DOUBLE AS y, tile_h AS shelf FROM s WHERE i = 1
  UNION ALL
  SELECT s.job_id, s.piece_id, s.part, s.i, w.page_no + new_page::INT, CASE WHEN new_page OR new_row THEN 0 ELSE w.x END,
    CASE WHEN new_page THEN 0 ELSE y1 END, CASE WHEN new_page OR new_row THEN 0 ELSE w.x END + s.tile_w + 0.12, CASE WHEN new_page THEN 0 ELSE y1 END,
    greatest(CASE WHEN new_page OR new_row THEN 0 ELSE w.shelf END, s.tile_h)
  FROM walk w JOIN s ON s.job_id = w.job_id AND s.i = w.i + 1,
  LATERAL (SELECT w.x + s.tile_w > 7.7 + 1e-6 AS new_row), LATERAL (SELECT CASE WHEN new_row THEN w.y + w.shelf + 0.12 ELSE w.y END AS y1),
  LATERAL (SELECT y1 + s.tile_h > 10.2 + 1e-6 AS new_page))
SELECT job_id, piece_id, part, page_no, round(0.4 + px, 6) AS x_in, round(0.4 + py, 6) AS y_in FROM walk""")
def _(t):
    out = ops.shelf_layout(_tiles(t), (8.5, 11))
    return out.select("job_id", "piece_id", "part", "page_no", F.round("x_in", 6).alias("x_in"), F.round("y_in", 6).alias("y_in"))


@check("piece_table", f"""WITH {BOXES},
e AS (SELECT o_orderkey AS entry_id, 'seed ' || o_custkey AS label, 600 AS px_w, 400 AS px_h, CASE WHEN o_orderkey % 3 <> 0 THEN 2.5 END AS w_in,
   CASE WHEN o_orderkey % 3 <> 0 THEN 2.0 END AS h_in FROM orders),
z AS (SELECT *, coalesce(w_in, px_w / 300.0) AS w, coalesce(h_in, px_h / 300.0) AS h FROM e)
SELECT entry_id, coalesce(box_id, 1) AS piece_no, CASE WHEN box_id IS NULL THEN label ELSE label || ' ' || printf('%02d', box_id) END AS label,
  round(CASE WHEN box_id IS NULL THEN w ELSE (x1 - x0) / (px_w / w) END, 6)::DOUBLE AS w_in, round(CASE WHEN box_id IS NULL THEN h ELSE (y1 - y0) / (px_w / w) END, 6)::DOUBLE AS h_in
FROM z LEFT JOIN boxes ON entry_id = page_id""")
def _(t):
    entries = t.orders.select(
        F.col("o_orderkey").alias("entry_id"), F.concat(F.lit("seed "), "o_custkey").alias("label"), F.lit(600).alias("px_w"),
        F.lit(400).alias("px_h"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN 2.5D END").alias("w_in"),
        F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN 2.0D END").alias("h_in"))
    cuts = boxes(t).withColumnsRenamed({"page_id": "entry_id", "box_id": "order_no"})
    out = ops.piece_table(entries, cuts)
    return out.withColumn("w_in", F.round("w_in", 6)).withColumn("h_in", F.round("h_in", 6))


@check("text_rows", f"""WITH RECURSIVE {BOXES},
q AS (SELECT page_id, box_id AS piece_id, y0, y1, x1 - x0 AS w, y1 - y0 AS h, trunc((x1 - x0) * (y1 - y0) * 0.7)::BIGINT AS area, (box_id * 20)::DOUBLE AS c FROM boxes),
ink AS (SELECT page_id, sum(area)::BIGINT AS total FROM q GROUP BY 1),
marks AS (SELECT q.*, total, (y0 + y1 - 1) / 2.0::DOUBLE AS cy FROM q JOIN ink USING (page_id) WHERE total >= 20 AND area >= 4 AND h >= 6
  AND ((w >= 2.5 * h AND w <= 12 * h AND area::DOUBLE / (w * h) < 0.88) OR (h <= 6 * w AND w <= 3 * h AND area <= 0.45 * total))),
med AS (SELECT page_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS med_h FROM marks GROUP BY 1),
lined AS (SELECT m.*, med_h, row_number() OVER (PARTITION BY m.page_id ORDER BY cy, piece_id) AS i FROM marks m JOIN med USING (page_id)),
walk AS (
  SELECT page_id, i, piece_id, 1 AS row_no, cy AS mean, 1 AS n FROM lined WHERE i = 1
  UNION ALL
  SELECT l.page_id, l.i, l.piece_id, CASE WHEN near THEN row_no ELSE row_no + 1 END, CASE WHEN near THEN (mean * n + cy) / (n + 1) ELSE cy END,
    CASE WHEN near THEN n + 1 ELSE 1 END
  FROM walk w JOIN lined l ON l.page_id = w.page_id AND l.i = w.i + 1, LATERAL (SELECT abs(l.cy - w.mean) <= 0.6::DOUBLE * l.med_h AS near)),
rowed AS (SELECT l.*, row_no FROM lined l JOIN walk USING (page_id, i)),
stats AS (SELECT page_id, row_no, count(*) AS items, bool_or(w >= 2.5 * h) AS wordy, max(y1) - min(y0) AS row_h, sum(area) AS row_area,
  sum(c * area) / sum(area) AS mc FROM rowed GROUP BY ALL),
kept AS (SELECT r.page_id, r.row_no, row_area, area, sqrt(3 * pow(c - mc, 2)) <= 80 AS near FROM rowed r JOIN stats USING (page_id, row_no)
  WHERE (items >= 2 OR wordy) AND row_h >= 0.5 * med_h),
per_row AS (SELECT page_id, row_no, coalesce(sum(area) FILTER (near), any_value(row_area)) AS ink FROM kept GROUP BY ALL),
found AS (SELECT page_id, sum(ink) AS ink, count(*) AS lines FROM per_row GROUP BY 1)
SELECT ink.page_id, coalesce(coalesce(found.ink, 0) / total::DOUBLE >= 0.85, false) AS text, coalesce(found.ink, 0) / total::DOUBLE AS share,
  coalesce(lines, 0)::BIGINT AS lines, coalesce(med_h, 0)::INT AS letter_px FROM ink LEFT JOIN found USING (page_id) LEFT JOIN med USING (page_id)""")
def _(t):
    b = boxes(t)
    pieces = b.select(
        "page_id", F.col("box_id").alias("piece_id"), "x0", "y0", "x1", "y1",
        F.expr("cast((x1 - x0) * (y1 - y0) * 0.7 AS bigint)").alias("area"), *[F.expr(f"cast(box_id * 20 AS double)").alias(c) for c in "rgb"])
    return ops.text_rows(pieces, pieces.groupBy("page_id").agg(F.sum("area").alias("total")))
