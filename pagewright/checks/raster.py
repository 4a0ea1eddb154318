"""Raster statistics checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.colour import channels_of, hex_of
from ..operators import raster as ops
from ..sources import images
from .registry import check
from .sheets import BORDER_SQL, HEIGHT, PIXELS_SQL, WIDTH, carriers, line_sums, line_sums_sql, sheet_boxes, sheet_pixels

WITH = f"WITH {PIXELS_SQL}"
GREY = "((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)"


@check("border_median", f"{WITH}, {BORDER_SQL} SELECT page_id, cr AS r, cg AS g, cb AS b FROM carrier")
def _(t):
    return ops.border_median(sheet_pixels(t))


@check("backdrop_mode", f"""{WITH}, {BORDER_SQL},
bins AS (SELECT page_id, r // 8 AS qr, g // 8 AS qg, b // 8 AS qb, count(*) AS k, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM border GROUP BY ALL),
best AS (SELECT * FROM bins QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k DESC, qr, qg, qb) = 1),
s AS (SELECT page_id, avg((greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 6)::INT) AS share, any_value(mr) AS mr, any_value(mg) AS mg, any_value(mb) AS mb
      FROM border JOIN best USING (page_id) GROUP BY page_id)
SELECT page_id, round(share, 6) AS share, CASE WHEN share >= 0.35 THEN round_even(mr, 0)::INT END AS r,
  CASE WHEN share >= 0.35 THEN round_even(mg, 0)::INT END AS g, CASE WHEN share >= 0.35 THEN round_even(mb, 0)::INT END AS b FROM s""")
def _(t):
    return ops.backdrop_mode(sheet_pixels(t)).withColumn("share", F.round("share", 6))


@check("sheet_mode", f"""{WITH},
bins AS (SELECT page_id, r // 16 AS qr, g // 16 AS qg, b // 16 AS qb, count(*) / {WIDTH * HEIGHT}.0 AS share FROM pixels GROUP BY ALL)
SELECT page_id, (qr * 16 + 8)::INT AS r, (qg * 16 + 8)::INT AS g, (qb * 16 + 8)::INT AS b FROM bins WHERE share >= 0.02
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY qr + qg + qb DESC, qr, qg, qb) = 1""")
def _(t):
    return ops.sheet_mode(sheet_pixels(t))


_KEYS = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(ops.KEY_COLOURS))


@check("key_colour_pick", f"""{WITH}, keys(i, kr, kg, kb) AS (VALUES {_KEYS}),
d AS (SELECT page_id, i, kr, kg, kb, quantile_cont((abs(r - kr) + abs(g - kg) + abs(b - kb))::DOUBLE, 0.01) AS far
      FROM pixels, keys WHERE a > 200 GROUP BY ALL)
SELECT page_id, kr AS r, kg AS g, kb AS b, round(far, 6) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY far DESC, i) = 1""")
def _(t):
    return ops.key_colour_pick(sheet_pixels(t)).withColumn("distance", F.round("distance", 6))


def _box_mean_sql(expr: str, r: int) -> str:
    return f"""s1 AS (SELECT *, sum({expr}) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS h FROM pixels),
s2 AS (SELECT *, sum(h) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)
  / ((least(x + {r}, {WIDTH - 1}) - greatest(x - {r}, 0) + 1) * (least(y + {r}, {HEIGHT - 1}) - greatest(y - {r}, 0) + 1)) AS m FROM s1)"""


@check("box_mean", f"{WITH}, {_box_mean_sql('g', 3)} {line_sums_sql('s2', 'm')}")
def _(t):
    return line_sums(ops.box_mean(sheet_pixels(t), "g", 3, "m"), "m")


def _frame(r, across):
    part, order = ("y", "x") if across else ("x", "y")
    return f"OVER (PARTITION BY page_id, {part} ORDER BY {order} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


@check("mask_morph", f"""{WITH},
m0 AS (SELECT page_id, y, x, (a > 96)::INT AS m FROM pixels),
d1 AS (SELECT *, max(m) {_frame(2, True)} AS dx, min(m) {_frame(2, True)} AS ex FROM m0),
d2 AS (SELECT *, max(dx) {_frame(2, False)} AS d,
  CASE WHEN x < 2 OR y < 2 OR x >= {WIDTH - 2} OR y >= {HEIGHT - 2} THEN 0 ELSE min(ex) {_frame(2, False)} END AS e FROM d1),
o1 AS (SELECT *, max(e) {_frame(2, True)} AS ox FROM d2),
o2 AS (SELECT *, max(ox) {_frame(2, False)} AS o FROM o1)
{line_sums_sql('o2', 'd', 'e', 'o')}""")
def _(t):
    p = sheet_pixels(t).select("page_id", "y", "x", "width", "height", (F.col("a") > 96).alias("m"))
    p = ops.mask_morph(p, "m", 2, {"d": "dilate", "e": "erode", "o": "open"})
    return line_sums(p.select("page_id", "y", "x", *[F.col(c).cast("int").alias(c) for c in "deo"]), "d", "e", "o")


@check("trim_box", f"""{WITH}
SELECT page_id, greatest(0, min(x) FILTER (a > 12) - 8) AS x0, greatest(0, min(y) FILTER (a > 12) - 8) AS y0,
  least({WIDTH}, max(x) FILTER (a > 12) + 9) AS x1, least({HEIGHT}, max(y) FILTER (a > 12) + 9) AS y1 FROM pixels GROUP BY page_id""")
def _(t):
    return ops.trim_box(sheet_pixels(t))


@check("sharpness_blockiness", f"""{WITH}, {BORDER_SQL},
v AS (SELECT page_id, y, x, r, g, b, {GREY} AS v FROM pixels),
n AS (SELECT *, lag(v) OVER rw AS l, lead(v) OVER rw AS rt, lag(v) OVER cl AS u, lead(v) OVER cl AS d FROM v
  WINDOW rw AS (PARTITION BY page_id, y ORDER BY x), cl AS (PARTITION BY page_id, x ORDER BY y)),
k AS (SELECT n.*, sqrt((r - cr)**2 + (g - cg)**2 + (b - cb)**2) < 52 AS bg FROM n JOIN carrier USING (page_id))
SELECT page_id, round(var_pop(l + rt + u + d - 4 * v), 4) AS sharpness,
  round(avg(abs(rt - v)) FILTER (x % 8 = 7) / greatest(1e-6, avg(abs(rt - v))), 6) AS blockiness,
  round(CASE WHEN avg(bg::INT) > 0.05 THEN stddev_pop(v) FILTER (bg) ELSE 0 END, 6) AS light_std FROM k GROUP BY page_id""")
def _(t):
    p = sheet_pixels(t)
    out = ops.sharpness_blockiness(p, carriers(p))
    return out.select("page_id", F.round("sharpness", 4).alias("sharpness"), F.round("blockiness", 6).alias("blockiness"),
                      F.round("light_std", 6).alias("light_std"))


_CLIP = [f"least(greatest(x + {d}, 0), {WIDTH - 1})" for d in (-1, 0, 1)]


@check("ink_grain", f"""{WITH}, {BORDER_SQL},
v AS (SELECT page_id, y, x, r, g, b, {GREY} AS v FROM pixels),
h AS (SELECT *, [coalesce(lag(v) OVER w, v), v, coalesce(lead(v) OVER w, v)] AS h FROM v WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
n AS (SELECT *, list_concat(coalesce(lag(h) OVER w, h), h, coalesce(lead(h) OVER w, h)) AS n9 FROM h WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
e AS (SELECT page_id, y, x, r, g, b, v, list_sort(n9)[5] AS med,
  CASE WHEN x > 0 AND y > 0 AND x < {WIDTH - 1} AND y < {HEIGHT - 1} THEN greatest(0, 9 * v - list_sum(n9)) ELSE v END > 40 AS edge FROM n),
w1 AS (SELECT *, max(edge::INT) {_frame(2, True)} AS ex FROM e),
w2 AS (SELECT *, max(ex) {_frame(2, False)} AS near FROM w1),
f AS (SELECT w2.*, greatest(abs(r - cr), abs(g - cg), abs(b - cb)) > 60 AND near = 0 AS flat FROM w2 JOIN carrier USING (page_id))
SELECT page_id, count(*) FILTER (flat) AS flat_pixels,
  round(CASE WHEN count(*) FILTER (flat) < 500 THEN 0 ELSE avg(abs(v - med)) FILTER (flat) END, 6)::DOUBLE AS grain FROM f GROUP BY page_id""")
def _(t):
    p = sheet_pixels(t)
    return ops.ink_grain(p, carriers(p)).withColumn("grain", F.round("grain", 6))


def _lines_sql(line: str, name: str) -> str:
    return f"""{name}m AS (SELECT page_id, {line} AS k, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM framed GROUP BY ALL),
{name}f AS (SELECT p.page_id, p.{line} AS k, avg((greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 6)::INT) < 0.98 AS rough
  FROM framed p JOIN {name}m m ON p.page_id = m.page_id AND p.{line} = m.k GROUP BY ALL)"""


_FRAME = "CASE WHEN page_id % 3 = 0 AND (y < page_id % 7 OR x >= {w} - page_id % 5) THEN 255 ELSE {c} END"
_DEEP = int(0.1 * max(WIDTH, HEIGHT)) + 1


@check("edge_strips", f"""{WITH},
framed AS (SELECT page_id, y, x, {', '.join(_FRAME.format(w=WIDTH, c=c) + ' AS ' + c for c in 'rgb')} FROM pixels),
{_lines_sql('y', 'ry')}, {_lines_sql('x', 'cx')},
a AS (SELECT page_id, least(coalesce(min(k) FILTER (rough), {HEIGHT}), {_DEEP})::INT AS top,
   least({HEIGHT - 1} - coalesce(max(k) FILTER (rough), -1), {_DEEP})::INT AS bottom FROM ryf GROUP BY 1),
b AS (SELECT page_id, least(coalesce(min(k) FILTER (rough), {WIDTH}), {_DEEP})::INT AS "left",
   least({WIDTH - 1} - coalesce(max(k) FILTER (rough), -1), {_DEEP})::INT AS "right" FROM cxf GROUP BY 1)
SELECT page_id, top, bottom, "left", "right" FROM a JOIN b USING (page_id)""")
def _(t):
    p = sheet_pixels(t)
    framed = p.select("page_id", "y", "x", "width", "height", *[F.expr(_FRAME.format(w=WIDTH, c=c)).alias(c) for c in "rgb"])
    return ops.edge_strips(framed)


_STREAK = "CASE WHEN x % 29 = 13 OR (x BETWEEN 60 AND 64 AND page_id % 2 = 0) THEN {c} - 60 ELSE {c} END"
STREAKED = f"streaked AS (SELECT page_id, y, x, {', '.join('(' + _STREAK.format(c=c) + ') AS ' + c for c in 'rgb')} FROM pixels)"
_PADDED = ", ".join(
    f"""{c} - (sum({c}) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
    + greatest(0, 12 - x) * first({c}) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    + greatest(0, x + 12 - {WIDTH - 1}) * last({c}) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 25.0 AS o{c}"""
    for c in "rgb")
STREAKS_SQL = f"""{STREAKED},
o AS (SELECT page_id, y, x, {_PADDED} FROM streaked),
bias AS (SELECT page_id, x, abs(median(o_r)) + abs(median(o_g)) + abs(median(o_b)) AS mag FROM (SELECT page_id, x, "or" AS o_r, og AS o_g, ob AS o_b FROM o) GROUP BY ALL),
md AS (SELECT *, median(mag) OVER (PARTITION BY page_id) AS med FROM bias),
zz AS (SELECT *, (mag - med) / (1.4826 * (median(abs(mag - med)) OVER (PARTITION BY page_id) + 1e-3)) AS z FROM md),
hot AS (SELECT *, x - row_number() OVER (PARTITION BY page_id ORDER BY x) AS island FROM zz WHERE z > 5),
thin AS (SELECT *, count(*) OVER (PARTITION BY page_id, island) AS run FROM hot QUALIFY run <= 3),
flags AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM thin QUALIFY n <= {WIDTH // 8})"""


def _streaked(t):
    return sheet_pixels(t).select("page_id", "y", "x", "width", "height", *[F.expr(_STREAK.format(c=c)).alias(c) for c in "rgb"])


@check("streak_columns", f"""{WITH}, {STREAKS_SQL.replace('AS or,', 'AS "or",')}
SELECT page_id, x, round(z, 4) AS z FROM flags""")
def _(t):
    return ops.streak_columns(_streaked(t)).withColumn("z", F.round("z", 4))


@check("destripe", f"""{WITH}, {STREAKS_SQL.replace('AS or,', 'AS "or",')},
sides AS (SELECT f.page_id, f.x, (SELECT max(n) FROM unnest(range(0, f.x)) u(n) WHERE (f.page_id, n) NOT IN (SELECT page_id, x FROM flags)) AS l,
   (SELECT min(n) FROM unnest(range(f.x + 1, {WIDTH})) u(n) WHERE (f.page_id, n) NOT IN (SELECT page_id, x FROM flags)) AS rt FROM flags f),
filled AS (SELECT s.page_id, s.y, s.x, {', '.join(f"CASE WHEN d.x IS NULL THEN s.{c} ELSE floor((coalesce(a.{c}, e.{c}) + coalesce(e.{c}, a.{c})) / 2.0)::INT END AS {c}" for c in 'rgb')}
FROM streaked s LEFT JOIN sides d ON s.page_id = d.page_id AND s.x = d.x
LEFT JOIN streaked a ON a.page_id = s.page_id AND a.y = s.y AND a.x = d.l LEFT JOIN streaked e ON e.page_id = s.page_id AND e.y = s.y AND e.x = d.rt)
{line_sums_sql('filled', 'r', 'g', 'b')}""")
def _(t):
    return line_sums(ops.destripe(_streaked(t).drop("a")), "r", "g", "b")


@check("ink_colour", f"""{WITH}
SELECT q.page_id, q.box_id, {', '.join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in 'rgb')}
FROM boxes q LEFT JOIN pixels p ON p.page_id = q.page_id AND p.x >= q.x0 AND p.x < q.x1 AND p.y >= q.y0 AND p.y < q.y1 AND p.a > 200 GROUP BY ALL""")
def _(t):
    b = sheet_boxes(t)
    out = ops.ink_colour(sheet_pixels(t, b), b)
    return out.select("page_id", "box_id", *[F.round(c, 6).alias(c) for c in "rgb"])


@check("nearest_colour", f"""{WITH},
c AS (SELECT DISTINCT page_id, r, g, b FROM pixels),
pal AS (SELECT DISTINCT page_id, box_id % 4 AS rank, CASE box_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 200 ELSE 20 END AS pr,
   CASE box_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 20 ELSE 40 END AS pg, CASE box_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 30 ELSE 180 END AS pb FROM boxes)
SELECT page_id, printf('#%02x%02x%02x', r, g, b) AS colour, printf('#%02x%02x%02x', pr, pg, pb) AS nearest FROM c JOIN pal USING (page_id)
QUALIFY row_number() OVER (PARTITION BY page_id, r, g, b ORDER BY (r - pr)**2 + (g - pg)**2 + (b - pb)**2, rank) = 1""")
def _(t):
    b = sheet_boxes(t)
    colours = sheet_pixels(t, b).select("page_id", "r", "g", "b").distinct()
    hexes = F.element_at(F.array(*[F.lit(h) for h in ("#000000", "#ffffff", "#c8141e", "#1428b4")]), F.col("box_id") % 4 + 1)
    palette = b.select("page_id", (F.col("box_id") % 4).alias("rank"), channels_of(hexes).alias("c")).distinct().select("page_id", "rank", "c.*")
    out = ops.nearest_colour(colours, palette)
    return out.select("page_id", hex_of("r", "g", "b").alias("colour"), hex_of("near_r", "near_g", "near_b").alias("nearest"))


@check("palette_census", f"""WITH RECURSIVE {PIXELS_SQL},
bins AS (SELECT p.page_id, b.box_id, r >> 3 AS qr, g >> 3 AS qg, b >> 3 AS qb, count(*) AS n, round_even(avg(r), 0)::INT AS r, round_even(avg(g), 0)::INT AS g, round_even(avg(p.b), 0)::INT AS b
  FROM pixels p JOIN boxes b ON b.page_id = p.page_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE a >= 250 GROUP BY ALL),
whitened AS (SELECT page_id, box_id, n, sum(n) OVER (PARTITION BY page_id, box_id) AS total, row_number() OVER (PARTITION BY page_id, box_id ORDER BY n DESC, qr, qg, qb) AS i,
  least(r, g, b) >= 215 AND greatest(r, g, b) - least(r, g, b) <= 20 AS pale, r, g, b FROM bins),
lined AS (SELECT page_id, box_id, i, n, total, {{'r': CASE WHEN pale THEN 255 ELSE r END, 'g': CASE WHEN pale THEN 255 ELSE g END, 'b': CASE WHEN pale THEN 255 ELSE b END, 'n': n}} AS c FROM whitened),
walk AS (
  SELECT page_id, box_id, i, total, [c] AS inks FROM lined WHERE i = 1
  UNION ALL
  SELECT w.page_id, w.box_id, l.i, w.total, CASE WHEN (l.n < 0.01 * l.total AND len(inks) >= 2) OR len(inks) >= 16
      OR len(list_filter(inks, lambda q: abs(q.r - l.c.r) + abs(q.g - l.c.g) + abs(q.b - l.c.b) <= 40)) > 0 THEN inks ELSE list_append(inks, l.c) END
  FROM walk w JOIN lined l ON l.page_id = w.page_id AND l.box_id = w.box_id AND l.i = w.i + 1),
last AS (SELECT page_id, box_id, total, inks FROM walk QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY i DESC) = 1),
flat AS (SELECT page_id, box_id, total, unnest(inks) AS c, generate_subscripts(inks, 1) - 1 AS rank FROM last)
SELECT page_id, box_id, rank::INT AS rank, c.r AS r, c.g AS g, c.b AS b, c.n / total::DOUBLE AS share FROM flat""")
def _(t):
    b = sheet_boxes(t)
    return ops.palette_census(sheet_pixels(t, b), b)


@check("palette_kmeans")
def _(t):
    return ops.palette_kmeans(sheet_pixels(t))


@check("src_pages_image", """
WITH raw AS (SELECT page_id, hex(encode(html)) AS x, (length(hex(encode(html))) + 95) // 96 AS height FROM pages),
img AS (SELECT page_id, rpad(x, (height * 96)::INT, '0') AS h, 16 AS width, height FROM raw),
px AS (SELECT page_id, h, width, height, unnest(range(width * height)) AS i FROM img)
SELECT 'page_' || page_id AS label, (i // 16)::INT AS y, (i % 16)::INT AS x,
  ('0x' || substr(h, (i * 6 + 5)::INT, 2))::INT AS r, ('0x' || substr(h, (i * 6 + 3)::INT, 2))::INT AS g, ('0x' || substr(h, (i * 6 + 1)::INT, 2))::INT AS b,
  255 AS a, width, height::INT AS height, CASE WHEN page_id % 3 = 0 THEN 300 END AS dpi FROM px""")
def _(t):
    raw = F.encode("html", "UTF-8")
    height = F.ceil(F.length(raw) / 48).cast("int")
    data = F.rpad(raw, height * 48, F.lit(b"\0"))
    decoded = t.pages.select(F.concat(F.lit("page_"), "page_id").alias("label"), F.struct(
        height.alias("height"), F.lit(16).alias("width"), F.lit(3).alias("nChannels"), data.alias("data")).alias("image"))
    dpi = t.pages.select(F.concat(F.lit("page_"), "page_id").alias("label"), F.expr("CASE WHEN page_id % 3 = 0 THEN 300 ELSE 72 END").alias("dpi"))
    return images.pixels_of(decoded, dpi)
