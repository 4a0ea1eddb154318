"""Registration of checks and access to the registered tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Order lines a task gets where they are dealt by number.
LINES_A_TASK = 250_000


class Tables:
    """``t.lineitem`` reads that table; Catalyst prunes its columns and pushes filters down."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def lines(self, *keys: str) -> DataFrame:
        """The order lines dealt by ``keys`` over tasks that grow with them. AQE sizes tasks by their compressed bytes, of which a task would get
        64 MB of small rows whatever they become afterwards: many lines more than it can sort or count in memory."""
        parts = max(self.spark.sparkContext.defaultParallelism, -(-self.lineitem.count() // LINES_A_TASK))
        # one more than the shuffle partitions, since Spark drops a repartition that equals the one before it
        return self.lineitem.repartition(parts + (parts == int(self.spark.conf.get("spark.sql.shuffle.partitions"))), *keys)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def check(key: str, sql: str | None = None):
    """Registers ``fn(tables)`` under ``key``; ``sql`` is its DuckDB equivalent."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return fn

    return wrap
