"""Model manifests and style presets as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "array<struct<dir:string, local:string, repo:string, remote_file:string, url:string>>"
PRESET_SCHEMA = "presets array<struct<name:string, style:string, negative:string, example:string, model_hint:string>>"


def read_json_lists(spark: SparkSession, path: str) -> DataFrame:
    """(host_id, value): one JSON list per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("host_id"), "value")


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(host_id, item_no, name, style, negative, example, model_hint): the style presets of every file below ``path``, one JSON object a file.

    A file that does not parse has none.
    """
    raw = read_json_lists(spark, path).select("host_id", F.from_json("value", PRESET_SCHEMA)["presets"].alias("p"))
    return raw.select("host_id", F.posexplode("p").alias("item_no", "i")).select("host_id", "item_no", "i.*")


def parse_lists(raw: DataFrame, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """One row per item of each host's list."""
    return raw.select("host_id", F.posexplode(F.from_json("value", schema)).alias("item_no", "i")).select(
        "host_id", "item_no", "i.*")
