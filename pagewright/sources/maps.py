"""Example maps: both layouts of a map file to one table of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit

MAP_SCHEMA = """
    schema string, name string, lora string, `trigger` string, image_dir string, weight double, top_k int,
    entries array<struct<image:string, keywords:array<string>, caption:string>>
"""
LEGACY_SCHEMA = """
    name string, lora string, images_dir string, embeddings_file string, embeddings_key string,
    entries array<struct<index:bigint, image:string, caption:string>>
"""
# fixed values: what a map that leaves a field out gets
DEFAULT_WEIGHT = 0.8
DEFAULT_TOP_K = 4
LORA_SUFFIX = ".safetensors"


def read_map_files(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Map files below ``path`` as (map_id, m), one JSON object per file."""
    schema = LEGACY_SCHEMA if legacy else MAP_SCHEMA
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("map_id"), "value")
    return raw.select("map_id", F.from_json("value", schema).alias("m"))


def parse_maps(raw: DataFrame, legacy: bool = False) -> DataFrame:
    """(map_id, value JSON text) rows as (map_id, m)."""
    return raw.select("map_id", F.from_json("value", LEGACY_SCHEMA if legacy else MAP_SCHEMA).alias("m"))


def _lora(name):
    return F.when(name.isNull() | (F.trim(name) == ""), None).otherwise(
        F.when(F.lower(name).endswith(LORA_SUFFIX), name).otherwise(F.concat(name, F.lit(LORA_SUFFIX)))
    )


def map_entries(current: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """One row per entry of every map with the map's settings, defaults applied.

    A map without a name is named after its folder or file without a trailing ``-rag``.
    """
    m = F.col("m")
    stem = F.regexp_replace(F.element_at(F.split("map_id", "/"), -1), r"(\.ragmap)?\.json$", "")
    own_name = F.regexp_replace(stem, "-rag$", "")

    def head(trigger, image_dir, weight, top_k):
        return [
            F.col("map_id"),
            F.coalesce(m["name"], own_name).alias("name"),
            _lora(m["lora"]).alias("lora"),
            trigger.alias("trigger"),
            F.coalesce(image_dir, F.lit(".")).alias("image_dir"),
            F.coalesce(weight, F.lit(DEFAULT_WEIGHT)).alias("weight"),
            F.coalesce(top_k, F.lit(DEFAULT_TOP_K)).alias("top_k"),
        ]

    new = current.select(
        *head(m["trigger"], m["image_dir"], m["weight"], m["top_k"]), F.posexplode("m.entries").alias("entry_idx", "e")
    ).select("*", "e.image", "e.keywords", "e.caption").drop("e")
    if legacy is None:
        return new
    none = F.lit(None)
    old = legacy.select(
        *head(none.cast("string"), m["images_dir"], none.cast("double"), none.cast("int")),
        F.posexplode("m.entries").alias("entry_idx", "e"),
    ).select("*", "e.image", "e.caption").drop("e")
    return new.unionByName(old, allowMissingColumns=True)


def map_vectors(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """Vectors of each map joined by row number and brought to unit length.

    A set whose row count differs from its map's entry count is ignored as a whole. Both sides
    have (map_id, entry_idx); counts combine before their shuffle and one row per map is joined.
    """
    have = vectors.groupBy("map_id").agg(F.count("*").alias("n_vectors"))
    want = entries.groupBy("map_id").agg(F.count("*").alias("n_entries"))
    fitting = have.join(want, "map_id").filter("n_vectors = n_entries").select("map_id")
    return (
        vectors.join(fitting, "map_id", "left_semi")
        .join(entries.select("map_id", "entry_idx"), ["map_id", "entry_idx"], "left_semi")
        .select("map_id", "entry_idx", unit(F.col("embedding")).alias("e"))
    )
