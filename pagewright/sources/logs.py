"""Log files as one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered

# fixed value: how a record starts; other lines continue the record before, indented by four blanks
HEAD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S+) +(.*)$"
INDENT = "^ {4}"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, line_no, value) of text logs. Big files are split by Spark; the block's offset and the row
    number inside it give back the order of lines without any task reading a whole file."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), "value")


def parse_log(lines: DataFrame) -> DataFrame:
    """(source, record, ts, level, text): continuation lines folded into their record.

    ``block`` cuts a long log into slices; the record number is a running count of heads over slices.
    """
    head = F.col("value").rlike(HEAD)
    marked = lines.withColumn(ordered.SLICE, F.col("block")).withColumn("_head", head.cast("int"))
    numbered = ordered.running_sum(marked, ["source"], [F.col("line_no")], F.col("_head"), "record")
    part = F.when(F.col("_head") == 1, F.regexp_extract("value", HEAD, 3)).otherwise(F.regexp_replace("value", INDENT, ""))
    at = F.struct(F.col(ordered.SLICE), F.col("line_no"), part.alias("text"))
    is_head = F.col("_head") == 1
    return numbered.groupBy("source", "record").agg(
        F.max(F.when(is_head, F.try_to_timestamp(F.regexp_extract("value", HEAD, 1), F.lit("yyyy-MM-dd HH:mm:ss")))).alias("ts"),
        F.max(F.when(is_head, F.regexp_extract("value", HEAD, 2))).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["text"]), "\n").alias("text"))
