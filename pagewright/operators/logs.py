"""Logs of many sources: repeats, retention, signs of damage, stalls.

Rows are (source, ts, line_id, level, text). One busy source may hold most of the rows, so everything ordered goes by
slices of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

# fixed values: log size limits, the tail looked at, the length of a stall
MAX_BYTES, KEEP_BYTES = 3 * 1024 * 1024, 1024 * 1024
DROPPED = "(older lines dropped)"
TAIL_CHARS = 4000
STALL_SECONDS = 5
# fixed values: what a damaged install writes
DAMAGE_SIGNS = (
    "No module named 'comfy", "No module named 'nodes'", "No module named 'server'", "No module named 'execution'", "can't open file",
)
STAMP_CHARS, LEVEL_CHARS = 19, 5


def _order() -> list[Column]:
    return [F.col("ts"), F.col("line_id")]


def by_time(log: DataFrame) -> DataFrame:
    """Cuts the sources, in the order of time, into slices of about as many rows."""
    return ordered.range_slices(log, ["source"], _order())


def repeat_collapse(log: DataFrame) -> DataFrame:
    """Immediate repeats of one (level, text) of a source written once."""
    said = F.struct("level", "text")
    seen = ordered.previous(by_time(log), ["source"], _order(), said, "before")
    return seen.filter(~said.eqNullSafe(F.col("before"))).select(*log.columns)


def line_bytes() -> Column:
    """Size of a record as it stands in its file: time, level, text with indented continuations, line ends."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n    "))
    return F.lit(STAMP_CHARS + 3) + F.greatest(F.length("level"), F.lit(LEVEL_CHARS)) + F.octet_length(text)


def _from_newest(log: DataFrame, size: Column) -> DataFrame:
    """Adds ``size``, ``total`` of the source and ``rest``: the size from this line to the newest."""
    sized = by_time(log).withColumn("size", size)
    run = ordered.running_sum(sized, ["source"], _order(), F.col("size"), "upto")
    total = sized.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("total"))
    whole = run.join(total, run["source"].eqNullSafe(total["_source"])).drop("_source")
    return whole.withColumn("rest", F.col("total") - F.col("upto") + F.col("size")).drop("upto", ordered.SLICE)


def log_retention(log: DataFrame, max_bytes: int = MAX_BYTES, keep_bytes: int = KEEP_BYTES) -> DataFrame:
    """Sources over ``max_bytes`` keep their newest whole lines inside ``keep_bytes``, after a line that says so."""
    w = _from_newest(log, line_bytes())
    over = F.col("total") > max_bytes
    kept = w.filter(~over | (F.col("rest") < keep_bytes)).select(*log.columns)
    kinds = {f.name: f.dataType for f in log.schema.fields}
    note = w.filter(over).select("source").distinct().select(*[
        F.col("source") if c == "source" else (F.lit(DROPPED) if c == "text" else F.lit(None)).cast(kinds[c]).alias(c) for c in log.columns])
    return kept.unionByName(note)


def damage_signs(log: DataFrame, signs: tuple[str, ...] = DAMAGE_SIGNS, tail: int = TAIL_CHARS) -> DataFrame:
    """(source, damaged): whether a damage phrase stands within the last characters of a source's log."""
    w = _from_newest(log, F.length("text") + 1)
    shown = w.filter(F.col("rest") - F.col("size") < tail).withColumn(
        "seen", F.when(F.col("rest") <= tail, F.col("text")).otherwise(
            F.expr(f"right(text, cast({tail} - (rest - size) - 1 AS int))")))
    hit = F.lit(False)
    for s in signs:
        hit = hit | F.contains(F.col("seen"), F.lit(s))
    return shown.groupBy("source").agg(F.bool_or(hit).alias("damaged"))


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def stall_gaps(beats: DataFrame, limit: float = STALL_SECONDS) -> DataFrame:
    """(source, stalled_at, resumed_at, seconds) wherever two heartbeats lie further apart than ``limit``."""
    p = ordered.previous(by_time(beats), ["source"], _order(), F.col("ts"), "before")
    gap = seconds_between(F.col("before"), F.col("ts"))
    return p.filter(gap > limit).select("source", F.col("before").alias("stalled_at"), F.col("ts").alias("resumed_at"), gap.alias("seconds"))
