"""Log checks: every event is a line of its user's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as ops
from ..sources import logs as log_source
from .registry import Tables, check

LOG = """
log AS (SELECT user_id AS source, ts, event_id AS line_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS text FROM events)"""


def log_lines(t: Tables):
    return t.events.select(
        F.col("user_id").alias("source"), "ts", F.col("event_id").alias("line_id"),
        F.expr("CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END").alias("level"), F.col("event_type").alias("text"))


@check("src_log", r"""
WITH rec AS (SELECT conv_id AS source, turn, TIMESTAMP '2024-03-01 10:00:00' + to_seconds(turn * 61) AS ts, CASE WHEN role = 'user' THEN 'INFO' ELSE 'ERROR' END AS level,
  replace(replace(text, chr(13), ' '), chr(8232), ' ') AS text FROM conversations)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY turn) AS record, ts, level, text FROM rec""")
def _(t):
    written = t.conversations.select(
        F.col("conv_id").alias("source"), "turn",
        F.split(F.concat(
            F.date_format(F.expr("TIMESTAMP '2024-03-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, turn * 61)"), "yyyy-MM-dd HH:mm:ss"),
            F.expr("CASE WHEN role = 'user' THEN ' INFO  ' ELSE ' ERROR ' END"),
            F.regexp_replace(F.regexp_replace("text", "[\r ]", " "), "\n", "\n    ")), "\n").alias("lines"))
    lines = written.select("source", F.posexplode("lines").alias("i", "value"), "turn").select(
        "source", F.expr("turn div 2").alias("block"), F.expr("turn * 1000000L + i").alias("line_no"), "value")
    out = log_source.parse_log(lines)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@check("repeat_collapse", f"""WITH {LOG}, p AS (SELECT *, lag(level) OVER w AS l, lag(text) OVER w AS x FROM log WINDOW w AS (PARTITION BY source ORDER BY ts, line_id))
SELECT source, ts, line_id, level, text FROM p WHERE l IS NULL OR l <> level OR x <> text""")
def _(t):
    return ops.repeat_collapse(log_lines(t))


SIZED = f"""{LOG}, z AS (SELECT *, 22 + greatest(length(level), 5) + length(text) AS size FROM log),
s AS (SELECT *, sum(size) OVER (PARTITION BY source) AS total, sum(size) OVER (PARTITION BY source ORDER BY ts DESC, line_id DESC) AS rest FROM z)"""


@check("log_retention", f"""WITH {SIZED}
SELECT source, ts, line_id, level, text FROM s WHERE total <= 2200 OR rest < 1000
UNION ALL SELECT DISTINCT source, NULL, NULL, NULL, '(older lines dropped)' FROM s WHERE total > 2200""")
def _(t):
    return ops.log_retention(log_lines(t), max_bytes=2200, keep_bytes=1000)


_PHRASED = "CASE WHEN value > 90 AND event_id % 3 = 0 THEN 'x No module named ''nodes'' y' ELSE event_type END"


@check("damage_signs", f"""
WITH l AS (SELECT user_id AS source, ts, event_id AS line_id, {_PHRASED} AS text FROM events),
w AS (SELECT source, right(string_agg(text || chr(10), '' ORDER BY ts, line_id), 400) AS tail FROM l GROUP BY source)
SELECT source, contains(tail, 'No module named ''nodes''') AS damaged FROM w""")
def _(t):
    log = t.events.select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("line_id"), F.expr(_PHRASED.replace("''nodes''", "\\'nodes\\'")).alias("text"))
    return ops.damage_signs(log, tail=400)


STALLS = f"""WITH {LOG}, p AS (SELECT *, lag(ts) OVER (PARTITION BY source ORDER BY ts, line_id) AS before FROM log)
SELECT source, before AS stalled_at, ts AS resumed_at, (epoch_us(ts) - epoch_us(before)) / 1e6 AS seconds FROM p WHERE epoch_us(ts) - epoch_us(before) > 5000000"""


@check("stall_gaps", STALLS)
def _(t):
    return ops.stall_gaps(log_lines(t))
