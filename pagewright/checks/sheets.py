"""Page rasters drawn from the order lines: a sheet per supplier, a box per line number.

Every order line moves a box or changes its size, so the rasters depend on the whole table; the number of
pages grows with the suppliers. The same arithmetic is written for Spark and for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

WIDTH, HEIGHT = 116, 84
#: Sheets a task draws: about half a million pixels.
SHEETS_A_TASK = 50

BOX_EXPRS = {
    "x0": "4 + (sum(l_partkey) % 12) * 8", "y0": "4 + (sum(l_orderkey) % 8) * 8",
    "w": "6 + sum(cast(l_quantity as bigint)) % 15", "h": "6 + count(*) % 15",
}
NOISE = "((x * 7 + y * 13) % 5 - 2)"
GRAIN = "((x * 3 + y * 5) % 3)"
PAPER = {"r": "(CASE WHEN page_id % 2 = 0 THEN 250 ELSE 214 END)", "g": "(CASE WHEN page_id % 2 = 0 THEN 250 ELSE 240 END)",
         "b": "(CASE WHEN page_id % 2 = 0 THEN 250 ELSE 242 END)"}
INK = {
    "r": f"(CASE box_id % 4 WHEN 0 THEN {GRAIN} WHEN 1 THEN 255 - {GRAIN} WHEN 2 THEN 200 + {GRAIN} ELSE 20 + {GRAIN} END)",
    "g": f"(CASE box_id % 4 WHEN 0 THEN {GRAIN} WHEN 1 THEN 255 - {GRAIN} WHEN 2 THEN 20 + {GRAIN} ELSE 40 + {GRAIN} END)",
    "b": f"(CASE box_id % 4 WHEN 0 THEN {GRAIN} WHEN 1 THEN 255 - {GRAIN} WHEN 2 THEN 30 + {GRAIN} ELSE 180 + {GRAIN} END)",
}
# every third box is a ring: its middle shows the paper
HOLE = "(box_id % 3 = 0 AND x1 - x0 >= 12 AND y1 - y0 >= 12 AND x >= x0 + 4 AND x < x1 - 4 AND y >= y0 + 4 AND y < y1 - 4)"
ALPHA = f"(CASE WHEN ink THEN CASE WHEN x = x0 THEN 120 ELSE 255 END ELSE CASE WHEN {NOISE} = 2 THEN 10 ELSE 0 END END)"
CHANNELS = {c: f"CASE WHEN ink THEN {INK[c]} ELSE {PAPER[c]} + {NOISE} END" for c in "rgb"}

BOXES_SQL = f"""
raw_boxes AS (SELECT l_suppkey AS page_id, l_linenumber AS box_id, ({BOX_EXPRS['x0']})::INT AS x0, ({BOX_EXPRS['y0']})::INT AS y0,
  ({BOX_EXPRS['w']})::INT AS w, ({BOX_EXPRS['h']})::INT AS h FROM lineitem GROUP BY ALL),
boxes AS (SELECT page_id, box_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM raw_boxes)"""

PIXELS_SQL = f"""{BOXES_SQL},
cover AS (SELECT page_id, y, x, max(box_id) AS box_id FROM
   (SELECT page_id, box_id, unnest(range(x0, x1)) AS x, y FROM (SELECT *, unnest(range(y0, y1)) AS y FROM boxes)) GROUP BY ALL),
grid AS (SELECT page_id, y.range::INT AS y, x.range::INT AS x FROM (SELECT DISTINCT page_id FROM boxes), range({HEIGHT}) y, range({WIDTH}) x),
spot AS (SELECT g.page_id, g.y, g.x, c.box_id, b.x0, b.y0, b.x1, b.y1 FROM grid g LEFT JOIN cover c ON g.page_id = c.page_id AND g.y = c.y AND g.x = c.x
   LEFT JOIN boxes b ON b.page_id = c.page_id AND b.box_id = c.box_id),
inked AS (SELECT *, box_id IS NOT NULL AND NOT {HOLE} AS ink FROM spot),
pixels AS MATERIALIZED (SELECT page_id, y, x, ({CHANNELS['r']})::INT AS r, ({CHANNELS['g']})::INT AS g, ({CHANNELS['b']})::INT AS b, {ALPHA} AS a,
   {WIDTH} AS width, {HEIGHT} AS height FROM inked)"""

BORDER_SQL = f"""
border AS (SELECT *, unnest(range(CASE WHEN y < 5 THEN 1 ELSE 0 END + CASE WHEN y >= {HEIGHT} - 5 THEN 1 ELSE 0 END
   + CASE WHEN x < 5 THEN 1 ELSE 0 END + CASE WHEN x >= {WIDTH} - 5 THEN 1 ELSE 0 END)) AS rep FROM pixels),
carrier AS (SELECT page_id, trunc(median(r))::INT AS cr, trunc(median(g))::INT AS cg, trunc(median(b))::INT AS cb FROM border GROUP BY page_id)"""


def sheet_boxes(t: Tables) -> DataFrame:
    raw = t.lineitem.groupBy(F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").alias("box_id")).agg(
        *[F.expr(f"cast({e} AS int)").alias(c) for c, e in BOX_EXPRS.items()])
    return raw.selectExpr("page_id", "box_id", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1")


def sheet_pixels(t: Tables, boxes: DataFrame | None = None) -> DataFrame:
    """All pixels of all sheets. A sheet has at most one box per line number, so they fit in its row."""
    b = sheet_boxes(t) if boxes is None else boxes
    pages = b.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "x0", "y0", "x1", "y1"))).alias("all"))
    # a few bytes per page become thousands of rows, which neither AQE nor a fixed number foresees: tasks grow with the pages. One more than
    # the shuffle partitions, since Spark drops a repartition that equals the one before it and AQE then packs all pages into one task
    n = t.lineitem.agg(F.approx_count_distinct("l_suppkey")).first()[0]
    shuffles = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    # with fewer parts than those, a join with page-level columns would shuffle the pixels
    parts = max(t.spark.sparkContext.defaultParallelism, -(-n // SHEETS_A_TASK), shuffles)
    pages = pages.repartition(parts + (parts == shuffles), "page_id")
    # lines come by a join, for the planner counts the rows of a join but not those of an explode, and would send all pixels to every task
    lines = t.spark.range(HEIGHT).select(F.col("id").cast("int").alias("y"))
    # a line is cut where a box begins or ends, so boxes are looked through once a stretch and not once a pixel
    ends = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0)), "row.x0", "row.x1"), lambda v: (v >= 0) & (v < WIDTH))))
    stretch = F.transform("cuts", lambda v, i: F.struct(
        v.alias("from"), F.coalesce(F.try_element_at("cuts", i + 2), F.lit(WIDTH)).alias("upto"),
        F.try_element_at(F.filter("row", lambda q: (q["x0"] <= v) & (v < q["x1"])), F.lit(-1)).alias("top")))
    dots = (
        pages.crossJoin(F.broadcast(lines))
        .withColumn("row", F.filter("all", lambda q: (q["y0"] <= F.col("y")) & (F.col("y") < q["y1"])))
        .withColumn("cuts", ends).withColumn("s", F.explode(stretch))
        .select("page_id", "y", "s.top.*", F.explode(F.sequence("s.from", F.col("s.upto") - 1)).alias("x"))
    )
    inked = dots.withColumn("ink", F.expr(f"box_id IS NOT NULL AND NOT {HOLE}"))
    return inked.select(
        "page_id", "y", "x", *[F.expr(CHANNELS[c]).cast("int").alias(c) for c in "rgb"], F.expr(ALPHA).alias("a"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def carriers(pixels: DataFrame) -> DataFrame:
    from ..operators.raster import border_median

    return border_median(pixels).withColumnsRenamed({"r": "cr", "g": "cg", "b": "cb"})


def line_sums(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    """Pixel results as two sums per raster line (plain and weighted by x): every pixel counts, the answer stays small."""
    n = {c: F.col(c).cast("double") for c in cols}
    return df.groupBy("page_id", "y").agg(*[
        F.round(F.sum(v * w), digits).alias(f"{c}_{name}") for c, v in n.items() for name, w in (("sum", F.lit(1)), ("at", F.col("x") + 1))])


def line_sums_sql(table: str, *cols: str, digits: int = 4) -> str:
    parts = ", ".join(
        f"round(sum(({c})::DOUBLE * {w}), {digits}) AS {c}_{name}" for c in cols for name, w in (("sum", "1"), ("at", "(x + 1)")))
    return f"SELECT page_id, y, {parts} FROM {table} GROUP BY page_id, y"
