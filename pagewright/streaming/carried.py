"""Continuous log work as micro-batches that hand a small table on.

Per-key state in a stateful operator pins a busy source to one task. Here each micro-batch runs the same sliced batch
operator, and what a source's next rows need (its last row, its highest generation) is written as one row per source
beside the output. Output and state of a batch are written under its number and overwritten when it is retried, so a
lost executor or a restarted query changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs, ordered

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def trigger(every: str | None) -> dict:
    """How often a stream looks for new rows: at an interval such as ``1 minute``, or all there is now and then an end."""
    return {"processingTime": every} if every else {"availableNow": True}


def run_carried(stream: DataFrame, path: str, state_schema: str, step: Step, every: str | None = None) -> StreamingQuery:
    """Starts ``step(batch, state) -> (output, new state)`` over a stream; results below ``path``."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            state = spark.createDataFrame([], state_schema)
        else:
            state = spark.read.schema(state_schema).parquet(f"{path}/state/batch={number - 1}")
        batch.persist()
        try:
            out, new_state = step(batch, state)
            out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
            new_state.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/progress")
    return writer.trigger(**trigger(every)).start()


def read_output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/out")


def _last(batch: DataFrame, state: DataFrame, *cols: str) -> DataFrame:
    """The newest row per source out of this batch and what was carried."""
    rows = state.unionByName(batch.select("source", "ts", "line_id", *cols))
    rest = [c for c in ("ts", "line_id", *cols)]
    return rows.groupBy("source").agg(F.max_by(F.struct(*rest), F.struct("ts", "line_id")).alias("r")).select("source", "r.*")


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with what was carried for their source; a null source is one of its own."""
    held = state.withColumnRenamed("source", "_source")
    return rows.join(held, rows["source"].eqNullSafe(held["_source"]), "left").drop("_source")


def repeat_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = F.struct("level", "text")
    seen = ordered.previous(logs.by_time(batch), ["source"], [F.col("ts"), F.col("line_id")], said, "before")
    kept = _with_state(seen, state.select("source", F.struct("level", "text").alias("carried"))).filter(~said.eqNullSafe(F.coalesce("before", "carried")))
    return kept.select(*batch.columns), _last(batch, state, "level", "text")


def stall_step(limit: float) -> Step:
    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = ordered.previous(logs.by_time(batch), ["source"], [F.col("ts"), F.col("line_id")], F.col("ts"), "before")
        p = _with_state(p, state.select("source", F.col("ts").alias("carried"))).withColumn("before", F.coalesce("before", "carried"))
        gap = logs.seconds_between(F.col("before"), F.col("ts"))
        out = p.filter(gap > limit).select("source", F.col("before").alias("stalled_at"), F.col("ts").alias("resumed_at"), gap.alias("seconds"))
        return out, _last(batch, state)

    return step


def generation_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps a message unless a newer generation of its source was seen before it."""
    top = ordered.running_max(logs.by_time(batch), ["source"], [F.col("ts"), F.col("line_id")], F.col("gen"), "top")
    joined = _with_state(top, state.select("source", F.col("gen").alias("carried")))
    kept = joined.filter(F.col("gen") >= F.greatest("top", "carried")).select(*batch.columns)
    new = state.unionByName(batch.select("source", "gen")).groupBy("source").agg(F.max("gen").alias("gen"))
    return kept, new


def _types(stream: DataFrame, *cols: str) -> str:
    kinds = dict(stream.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in cols)


def collapse_repeats(stream: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Immediate repeats of an unbounded log written once."""
    return run_carried(stream, path, _types(stream, "source", "ts", "line_id", "level", "text"), repeat_step, every)


def find_stalls(stream: DataFrame, path: str, limit: float = logs.STALL_SECONDS, every: str | None = None) -> StreamingQuery:
    """Heartbeats further apart than ``limit``."""
    return run_carried(stream, path, _types(stream, "source", "ts", "line_id"), stall_step(limit), every)


def newest_generation(stream: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Messages (source, ts, line_id, gen, ...) of a generation older than the newest seen are left out."""
    return run_carried(stream, path, _types(stream, "source", "gen"), generation_step, every)
