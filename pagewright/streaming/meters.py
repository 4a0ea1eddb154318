"""Streaming aggregates and lookups that Structured Streaming keeps state for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.answers import cache_lookup
from .carried import trigger


def cost_meter(calls: DataFrame, path: str, bucket: str = "1 hour", late: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Running cost, calls and tokens per time bucket of (ts, cost). Each batch writes the buckets it changed under its number.

    Sums combine before the shuffle and the state is one row per open bucket.
    """
    totals = calls.withWatermark("ts", late).groupBy(F.window("ts", bucket).alias("w")).agg(
        F.sum("cost").alias("cost"), F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "cost", "calls")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    return (
        totals.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/progress")
        .trigger(**trigger(every)).start()
    )


def meter_reading(spark: SparkSession, path: str) -> DataFrame:
    """The latest figures of every bucket."""
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("start").agg(F.max_by(F.struct("cost", "calls"), "batch").alias("r")).select("start", "r.*")


def stream_lookup(requests: DataFrame, answers: DataFrame, path: str, late: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Requests of a stream answered from the store; a key asked again within the watermark is passed on once."""
    once = requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])
    return (
        cache_lookup(once, answers).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/progress").trigger(**trigger(every)).start()
    )
