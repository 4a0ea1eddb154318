"""Streaming checks: the events table read as a stream, held against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..streaming import carried, meters
from .logs import LOG, STALLS
from .registry import Tables, check


def event_stream(t: Tables):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 16).parquet(t.dir)


def log_stream(t: Tables):
    return event_stream(t).select(
        F.col("user_id").alias("source"), "ts", F.col("event_id").alias("line_id"),
        F.expr("CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END").alias("level"), F.col("event_type").alias("text"))


@check("stream_repeat_collapse", f"""WITH {LOG}, p AS (SELECT *, lag(level) OVER w AS l, lag(text) OVER w AS x FROM log WINDOW w AS (PARTITION BY source ORDER BY ts, line_id))
SELECT source, ts, line_id, level, text FROM p WHERE l IS NULL OR l <> level OR x <> text""")
def _(t):
    path = fresh_path(t.spark, "repeats")
    carried.collapse_repeats(log_stream(t), path).awaitTermination()
    return carried.read_output(t.spark, path).drop("batch")


@check("stream_stalls", STALLS)
def _(t):
    path = fresh_path(t.spark, "stalls")
    carried.find_stalls(log_stream(t).select("source", "ts", "line_id"), path).awaitTermination()
    return carried.read_output(t.spark, path).drop("batch")


@check("stream_newest_generation", """
WITH m AS (SELECT user_id AS source, ts, event_id AS line_id, (event_id // 700 + event_id * 7 % 3)::BIGINT AS gen FROM events),
r AS (SELECT *, max(gen) OVER (PARTITION BY source ORDER BY ts, line_id) AS top FROM m)
SELECT source, ts, line_id, gen FROM r WHERE gen >= top""")
def _(t):
    path = fresh_path(t.spark, "generations")
    messages = event_stream(t).select(
        F.col("user_id").alias("source"), "ts", F.col("event_id").alias("line_id"), F.expr("event_id div 700 + event_id * 7 % 3").alias("gen"))
    carried.newest_generation(messages, path).awaitTermination()
    return carried.read_output(t.spark, path).drop("batch")


@check("stream_cost_meter", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, round(sum(value / 1000), 6) AS cost, count(*) AS calls FROM events GROUP BY 1""")
def _(t):
    path = fresh_path(t.spark, "meter")
    calls = event_stream(t).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 1000).alias("cost"))
    meters.cost_meter(calls, path).awaitTermination()
    out = meters.meter_reading(t.spark, path)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("cost", 6).alias("cost"), "calls")


@check("stream_cache_lookup", """
WITH e AS (SELECT event_type || '-' || user_id AS key, ts FROM events),
f AS (SELECT key, min(ts) AS ts FROM e GROUP BY key)
SELECT key, split_part(key, '-', 2)::BIGINT % 3 = 0 AS hit, CASE WHEN split_part(key, '-', 2)::BIGINT % 3 = 0 THEN 'stored ' || key END AS answer FROM f""")
def _(t):
    path = fresh_path(t.spark, "lookup")
    asked = event_stream(t).select(F.concat("event_type", F.lit("-"), "user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    answers = t.events.filter("user_id % 3 = 0").select(F.concat("event_type", F.lit("-"), "user_id").alias("key")).distinct().withColumn(
        "text", F.concat(F.lit("stored "), "key"))
    meters.stream_lookup(asked, answers, path, late="400 days").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("key", "hit", "answer")
