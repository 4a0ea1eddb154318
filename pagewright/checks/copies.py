"""Copy, selection and composition checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import copies as ops
from ..operators import ordered, raster
from ..session import is_empty
from .boxes import BOXES, boxes
from .registry import check
from .sheets import PIXELS_SQL, sheet_boxes, sheet_pixels

G = ops.GRID
#: Composed pages a task makes the pixels of: about a million and a half.
PAGES_A_TASK = 500
SIG_SQL = f"""
mixed AS (SELECT page_id, y, x, a, {', '.join(f"(({c} * a + 128 * (255 - a)) // 255) AS {c}" for c in 'rgb')} FROM pixels),
lum AS (SELECT *, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS v FROM mixed),
lh AS (SELECT *, coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v) AS h FROM lum WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
ed AS (SELECT *, least(255, greatest(0, 9 * v - (coalesce(lag(h) OVER w, h) + h + coalesce(lead(h) OVER w, h)))) AS e FROM lh WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
ib AS (SELECT q.page_id, q.box_id, q.x1 - q.x0 AS w, q.y1 - q.y0 AS h, e.y, e.x, e.a, e.r, e.g, e.b, e.e FROM boxes q JOIN ed e ON e.page_id = q.page_id AND e.x >= q.x0 AND e.x < q.x1 AND e.y >= q.y0 AND e.y < q.y1),
bb AS (SELECT page_id, box_id, min(x) FILTER (a > 96) AS i0, min(y) FILTER (a > 96) AS j0, max(x) FILTER (a > 96) + 1 AS i1, max(y) FILTER (a > 96) + 1 AS j1,
  min(x) AS bx0, min(y) AS by0, max(x) + 1 AS bx1, max(y) + 1 AS by1 FROM ib GROUP BY ALL),
fr AS (SELECT page_id, box_id, coalesce(i0, bx0) AS i0, coalesce(j0, by0) AS j0, coalesce(i1, bx1) AS i1, coalesce(j1, by1) AS j1 FROM bb),
cut AS (SELECT ib.*, x - i0 AS u, y - j0 AS t, i1 - i0 AS iw, j1 - j0 AS ih FROM ib JOIN fr USING (page_id, box_id) WHERE x >= i0 AND x < i1 AND y >= j0 AND y < j1),
sp AS (SELECT *, unnest(range(u * {G} // iw, ((u + 1) * {G} - 1) // iw + 1)) AS cx FROM cut),
sq AS (SELECT *, unnest(range(t * {G} // ih, ((t + 1) * {G} - 1) // ih + 1)) AS cy FROM sp),
wt AS (SELECT *, (least((u + 1) * {G}, (cx + 1) * iw) - greatest(u * {G}, cx * iw)) * (least((t + 1) * {G}, (cy + 1) * ih) - greatest(t * {G}, cy * ih)) AS wgt FROM sq),
cells AS MATERIALIZED (SELECT page_id, box_id, w, h, cy, cx, {', '.join(f'sum({c} * wgt) / sum(wgt) AS {c}' for c in 'rgbe')}, sum(CASE WHEN a > 96 THEN 255 ELSE 0 END * wgt) / sum(wgt) AS s
  FROM wt GROUP BY ALL)"""


def signatures(t, b=None, p=None):
    b = sheet_boxes(t) if b is None else b
    return ops.piece_signature(sheet_pixels(t, b) if p is None else p, b)


_PARTS = {"picture": "r", "shape": "s", "edges": "e"}


@check("piece_signature", f"""WITH {PIXELS_SQL}, {SIG_SQL}
SELECT page_id, box_id, w, h, round(sum(r + g + b), 4) AS picture_sum, round(sum(r * (cy * {G} + cx + 1)), 3) AS red_at, round(sum(s * (cy * {G} + cx + 1)), 3) AS shape_at,
  round(sum(e * (cy * {G} + cx + 1)), 3) AS edges_at, count(*) AS cells FROM cells GROUP BY ALL""")
def _(t):
    s = signatures(t)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    at = lambda c: total(F.transform(c, lambda v, i: v * (i + 1)))
    return s.select(
        "page_id", "box_id", "w", "h", F.round(total("picture"), 4).alias("picture_sum"), F.round(at(F.slice("picture", 1, G * G)), 3).alias("red_at"),
        F.round(at("shape"), 3).alias("shape_at"), F.round(at("edges"), 3).alias("edges_at"), F.size("shape").cast("long").alias("cells"))


@check("ncc_pairs", f"""WITH {PIXELS_SQL}, {SIG_SQL},
z AS (SELECT page_id, box_id, cy, cx, s - avg(s) OVER (PARTITION BY page_id, box_id) AS v FROM cells),
nn AS (SELECT page_id, box_id, sqrt(sum(v * v)) + 1e-6 AS n FROM z GROUP BY ALL),
prs AS (SELECT page_id, min(box_id) OVER (PARTITION BY page_id) AS box_a, box_id AS box_b FROM boxes),
sh AS (SELECT d.dy, e.dx FROM (SELECT unnest([-1, 0, 1]) AS dy) d, (SELECT unnest([-1, 0, 1]) AS dx) e),
dots AS (SELECT p.page_id, p.box_a, p.box_b, dy, dx, sum(a.v * b.v) AS d FROM prs p JOIN z a ON a.page_id = p.page_id AND a.box_id = p.box_a, sh
  JOIN z b ON b.page_id = p.page_id AND b.box_id = p.box_b AND b.cy = (a.cy - dy + {G}) % {G} AND b.cx = (a.cx - dx + {G}) % {G}
  WHERE p.box_b > p.box_a GROUP BY ALL)
SELECT d.page_id, box_a, box_b, round(greatest(-1.0, max(d / (x.n * y.n))), 6) AS ncc FROM dots d
 JOIN nn x ON x.page_id = d.page_id AND x.box_id = box_a JOIN nn y ON y.page_id = d.page_id AND y.box_id = box_b GROUP BY ALL""")
def _(t):
    b = sheet_boxes(t)
    lead = b.groupBy("page_id").agg(F.min("box_id").alias("box_a"))
    pairs = b.join(lead, "page_id").filter("box_id > box_a").select("page_id", "box_a", F.col("box_id").alias("box_b"))
    return ops.ncc_pairs(pairs, signatures(t, b), "shape").withColumn("ncc", F.round("ncc", 6))


@check("copy_groups")
def _(t):
    b = sheet_boxes(t)
    p = sheet_pixels(t, b)
    return ops.copy_groups(signatures(t, b, p), raster.ink_colour(p, b))


ATTEMPTS = f"""{BOXES},
att AS (SELECT page_id * 10 + box_id AS piece_id, box_id, page_id, try_no, ['text', 'geometric', 'vector', 'trace'][(box_id + try_no) % (4 - page_id % 2) + 1] AS method,
   CASE WHEN (page_id + box_id + try_no) % 13 <> 0 THEN ((page_id * 3 + box_id * 5 + try_no * 2) % 11)::INT END AS score FROM boxes, (SELECT unnest([0, 1, 2, 3]) AS try_no))"""


def _attempts(t):
    return boxes(t).withColumn("try_no", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
        F.expr("page_id * 10 + box_id").alias("piece_id"), "try_no",
        F.expr("element_at(array('text', 'geometric', 'vector', 'trace'), cast((box_id + try_no) % (4 - page_id % 2) + 1 AS int))").alias("method"),
        F.expr("CASE WHEN (page_id + box_id + try_no) % 13 <> 0 THEN cast((page_id * 3 + box_id * 5 + try_no * 2) % 11 AS int) END").alias("score"))


@check("attempt_select", f"""WITH RECURSIVE {ATTEMPTS},
walk AS (SELECT piece_id, 0 AS at_try, method, score, 0 AS best, [method] AS tried, false AS stop FROM att WHERE try_no = 0
 UNION ALL
 SELECT w.piece_id, w.at_try + 1, CASE WHEN win THEN a.method ELSE w.method END, CASE WHEN win THEN a.score ELSE w.score END, CASE WHEN win THEN a.try_no ELSE w.best END,
   CASE WHEN halt THEN w.tried ELSE list_append(w.tried, a.method) END, halt
 FROM walk w JOIN att a ON a.piece_id = w.piece_id AND a.try_no = w.at_try + 1,
 LATERAL (SELECT w.stop OR w.score IS NULL OR w.score >= 7 OR list_contains(w.tried, a.method) AS halt),
 LATERAL (SELECT NOT halt AND coalesce(a.score >= w.score + 2 OR (a.method = 'text' AND a.score >= w.score), false) AS win) WHERE w.at_try < 2)
SELECT piece_id, method, score, best <> 0 AS improved, coalesce(score < 7, false) AS low, len(tried)::INT AS tries FROM walk WHERE at_try = 2""")
def _(t):
    return ops.attempt_select(_attempts(t))


@check("group_representative", """
WITH m AS (SELECT l_suppkey AS page_id, l_linenumber AS group_id, l_orderkey AS pos, min(l_partkey) AS box_id,
   CASE WHEN (l_suppkey + l_linenumber + l_orderkey) % 3 = 0 THEN 'text' ELSE 'vector' END AS method, (min(l_partkey) % 97) / 97.0::DOUBLE AS own_score, (min(l_partkey) % 89) / 80.0::DOUBLE AS mean_fit
   FROM lineitem GROUP BY l_suppkey, l_linenumber, l_orderkey),
c AS (SELECT *, row_number() OVER w AS n, first(method) OVER w = 'text' AS txt, max(mean_fit) OVER (PARTITION BY page_id, group_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
   FROM m WINDOW w AS (PARTITION BY page_id, group_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN txt THEN own_score + CASE WHEN method = 'text' THEN 0.25 ELSE 0 END ELSE mean_fit END AS key FROM c WHERE n <= 3 AND (txt OR prev IS NULL OR prev < 0.85)),
r AS (SELECT *, count(*) OVER (PARTITION BY page_id, group_id) AS drawn, row_number() OVER (PARTITION BY page_id, group_id ORDER BY key DESC, n) AS pick FROM k)
SELECT page_id, group_id, box_id, method, round(key, 6) AS key, drawn FROM r WHERE pick = 1""")
def _(t):
    m = t.lines("l_suppkey", "l_linenumber", "l_orderkey").groupBy("l_suppkey", "l_linenumber", "l_orderkey").agg(F.min("l_partkey").alias("box_id")).select(
        F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").alias("group_id"), F.col("l_orderkey").alias("pos"), "box_id",
        F.expr("CASE WHEN (l_suppkey + l_linenumber + l_orderkey) % 3 = 0 THEN 'text' ELSE 'vector' END").alias("method"),
        F.expr("(box_id % 97) / 97.0D").alias("own_score"), F.expr("(box_id % 89) / 80.0D").alias("mean_fit"))
    return ops.group_representative(m).withColumn("key", F.round("key", 6))


@check("sheet_compose", f"""WITH {BOXES},
parts AS (SELECT page_id, box_id, x0, y0, d.range AS dy, e.range AS dx FROM boxes, LATERAL (SELECT unnest(range((y1 - y0)::BIGINT)) AS range) d, LATERAL (SELECT unnest(range((x1 - x0)::BIGINT)) AS range) e),
placed AS (SELECT page_id, box_id, round_even(y0 * 0.5, 0)::INT + dy AS y, round_even(x0 * 0.5, 0)::INT + dx AS x, (dy * 5 + box_id) % 256 AS r, (dx * 7) % 256 AS g, 9 AS b, (dx + dy) % 4 * 85 AS a FROM parts),
top AS (SELECT page_id, y, x, max(box_id) AS box_id, arg_max(r, box_id) AS r, arg_max(g, box_id) AS g, arg_max(a, box_id) AS a FROM placed WHERE a > 0 GROUP BY ALL)
SELECT page_id, count(*) AS pixels, sum((box_id + r + g + a) * (x + 1))::BIGINT AS by_x, sum((box_id + r + g + a) * (y + 1))::BIGINT AS by_y FROM top GROUP BY page_id""")
def _(t):
    few, many = ops.by_ink(boxes(t))
    out = ops.compose_held(few, _drawn, _sums, "pixels bigint, by_x bigint, by_y bigint", 0.5)
    return out if is_empty(many) else out.unionByName(_composed_by_rows(t, many))


def _drawn(box_id, y, x):
    return {"r": (y * 5 + box_id) % 256, "g": x * 7 % 256, "b": np.full(len(x), 9), "a": (x + y) % 4 * 85}


def _sums(at, n, y, x, box_id, c):
    v = box_id + c["r"] + c["g"] + c["a"]
    total = lambda w: np.bincount(at, w, n).astype(np.int64)
    return {"pixels": np.bincount(at, minlength=n), "by_x": total(v * (x + 1)), "by_y": total(v * (y + 1))}


def _composed_by_rows(t, b):
    # a page's few boxes become thousands of pixels: tasks grow with the pages
    n = t.lineitem.agg(F.approx_count_distinct("l_orderkey")).first()[0]
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-n // PAGES_A_TASK))
    dealt = b.repartition(tasks + (tasks == int(t.spark.conf.get("spark.sql.shuffle.partitions"))), "page_id")
    parts = dealt.filter("x1 > x0 AND y1 > y0").withColumn("y", F.explode(F.expr("sequence(0, y1 - y0 - 1)"))).withColumn(
        "x", F.explode(F.expr("sequence(0, x1 - x0 - 1)"))).select(
        "page_id", "box_id", "y", "x", F.expr("cast((y * 5 + box_id) % 256 AS int)").alias("r"), F.expr("(x * 7) % 256").alias("g"), F.lit(9).alias("b"),
        F.expr("(x + y) % 4 * 85").alias("a"))
    v = F.col("box_id") + F.col("r") + F.col("g") + F.col("a")
    return ops.sheet_compose(parts, b, 0.5).groupBy("page_id").agg(
        F.count("*").alias("pixels"), F.sum(v * (F.col("x") + 1)).alias("by_x"), F.sum(v * (F.col("y") + 1)).alias("by_y"))


def frames(t):
    """Embeddings as the frames of a clip per label, numbered by slices: a label may hold a large part of all rows."""
    sliced = ordered.range_slices(t.embeddings.select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    numbered = ordered.number_rows(sliced, ["label"], [F.col("vec_id")], "_n")
    return numbered.select(F.col("label").alias("clip"), (F.col("_n") - 1).cast("int").alias("frame_no"), F.col("embedding").alias("e"))


@check("loop_cut", """
WITH f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
s AS (SELECT *, coalesce(list_sum(list_transform(list_zip(lag(e) OVER w, e), lambda p: abs(p[1] - p[2]))) / len(e), 0) AS step FROM f WINDOW w AS (PARTITION BY clip ORDER BY n)),
p AS (SELECT *, sum(step) OVER (PARTITION BY clip ORDER BY n) AS path, sum(step) OVER (PARTITION BY clip) / (count(*) OVER (PARTITION BY clip) - 1) AS usual FROM s),
j AS (SELECT a.clip, a.n AS start, b.n AS stop, list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))) / len(a.e) AS gap
  FROM p a JOIN p b ON a.clip = b.clip AND b.n - a.n BETWEEN 8 AND 48 WHERE (b.path - a.path) / (b.n - a.n) >= 0.6 * a.usual)
SELECT clip, arg_min(start, (gap, start, stop))::INT AS start, arg_min(stop, (gap, start, stop))::INT AS stop, round(min(gap), 6) AS gap FROM j GROUP BY clip""")
def _(t):
    return ops.loop_cut(frames(t), 8, 48).withColumn("gap", F.round("gap", 6))


@check("loop_cut_long", """
WITH f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
s AS (SELECT *, coalesce(list_sum(list_transform(list_zip(lag(e) OVER w, e), lambda p: abs(p[1] - p[2]))) / len(e), 0) AS step FROM f WINDOW w AS (PARTITION BY clip ORDER BY n)),
p AS (SELECT *, sum(step) OVER (PARTITION BY clip ORDER BY n) AS path, sum(step) OVER (PARTITION BY clip) / (count(*) OVER (PARTITION BY clip) - 1) AS usual FROM s),
j AS (SELECT a.clip, a.n AS start, b.n AS stop, list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))) / len(a.e) AS gap
  FROM p a JOIN p b ON a.clip = b.clip AND b.n - a.n BETWEEN 20 AND 150 WHERE (b.path - a.path) / (b.n - a.n) >= 0.6 * a.usual)
SELECT clip, arg_min(start, (gap, start, stop))::INT AS start, arg_min(stop, (gap, start, stop))::INT AS stop, round(min(gap), 6) AS gap FROM j GROUP BY clip""")
def _(t):
    return ops.loop_cut(frames(t), 20, 150).withColumn("gap", F.round("gap", 6))
