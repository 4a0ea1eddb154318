"""The store of saved recipes, and the people the recipes show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order
from . import ordered

# fixed values: name rule of a saved recipe, length of the rebuilt history
DEFAULT_NAME = "Variation"
NAME_CHARS = 80
HISTORY = 200

CONFIG_SCHEMA = "prompt string, model string, loras array<string>, preset string"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _or_default(c: Column, default: str) -> Column:
    return F.when(c.isNull() | (c == ""), default).otherwise(c)


def numbered_after(rows: DataFrame, store: DataFrame, order: str) -> DataFrame:
    """``id`` for new rows: they continue after the store's highest, in order of ``order``.

    Numbers come from per-slice counts, so no single task sees all rows.
    """
    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long"))
    n = ordered.number_rows(ordered.range_slices(rows, [], [order]), [], [F.col(order)], "_n")
    return n.withColumn("_top", top.scalar()).withColumn("id", F.col("_top") + F.col("_n")).drop("_n", "_top", ordered.SLICE)


def store_add(store: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows normalised and numbered: name, description, config text, seed text, file paths.

    ``new`` has (name, description, config struct or null, seed, saved_at) and a unique ``order`` column,
    which also makes the file names unique among rows saved in the same second.
    """
    name = _or_default(F.substring(_strip(_or_default(F.col("name"), DEFAULT_NAME)), 1, NAME_CHARS), DEFAULT_NAME)
    stamp = F.concat_ws("_", F.date_format("saved_at", "yyyyMMdd_HHmmss"), F.substring(md5_order(F.col(order)), 1, 8))
    rows = new.select(
        order, name.alias("name"), _strip(F.coalesce("description", F.lit(""))).alias("description"),
        F.concat(stamp, F.lit("_face.png")).alias("face_path"), F.concat(stamp, F.lit("_ref.png")).alias("ref_path"),
        F.coalesce(F.to_json("config"), F.lit("{}")).alias("config"),
        F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("seed"), stamp.alias("created"),
    )
    return numbered_after(rows, store, order).drop(order)


def config_of(config: Column) -> Column:
    """The stored config as a struct; anything that does not parse is an empty one."""
    text = F.when(F.try_parse_json(config).isNotNull(), config).otherwise("{}")
    return F.from_json(text, CONFIG_SCHEMA)


def store_load(store: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Rows with their typed config, newest id first; ``ids`` looks some up."""
    rows = store if ids is None else store.filter(F.col("id").isin(*ids))
    return rows.withColumn("settings", config_of(F.col("config"))).orderBy(F.desc("id"))


def store_merge(store: DataFrame, incoming: DataFrame, files: DataFrame) -> DataFrame:
    """Store plus another's rows under new ids. Rows lacking either picture are dropped; doing it twice adds copies."""
    def has(df, col):
        return df.join(files.select(F.col("file").alias(col)), col, "left_semi")

    whole = has(has(incoming, "face_path"), "ref_path")
    return store.unionByName(numbered_after(whole.withColumnRenamed("id", "old_id"), store, "old_id").drop("old_id"))


def store_delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids, "id", "left_anti")


def deleted_files(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, file) of the pictures that go with deleted rows."""
    return store.join(ids, "id", "left_semi").select("id", F.explode(F.array("face_path", "ref_path")).alias("file"))


def people_union(people: DataFrame, characters: DataFrame) -> DataFrame:
    """Both kinds in the person shape; columns one side lacks are null. Any subset of extra columns works."""
    as_people = characters.select(
        F.col("comicvine_id").cast("string").alias("imdb_id"), F.col("name").alias("first_name"),
        *[c for c in characters.columns if c not in ("comicvine_id", "name")],
        F.lit("character").alias("kind"),
    )
    return people.withColumn("kind", F.lit("person")).unionByName(as_people, allowMissingColumns=True)


def photo_rotation(photos: DataFrame, excluded: DataFrame, chosen: DataFrame, cap: int | None = None) -> DataFrame:
    """The photos to send per person: primary first, then by ``seq``, turned so the chosen one leads.

    ``photos`` has (person_id, is_primary, seq) with ``seq`` unique per person, ``excluded`` (person_id, idx),
    ``chosen`` (person_id, idx). Excluded ones are left out unless that would leave none. A person with
    very many photos is numbered slice by slice.
    """
    pos = F.when(F.col("is_primary"), F.lit(-1)).otherwise(F.col("seq")).cast("long")
    sliced = ordered.range_slices(photos.withColumn("_pos", pos), ["person_id"], ["_pos", "seq"])
    order = [F.col("_pos"), F.col("seq")]
    numbered = ordered.number_rows(sliced, ["person_id"], order, "_n").withColumn("idx", (F.col("_n") - 1).cast("long"))
    out = excluded.select("person_id", F.col("idx").cast("long").alias("idx"), F.lit(True).alias("_out"))
    marked = numbered.join(out, ["person_id", "idx"], "left")
    per_person = marked.groupBy("person_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("_out").isNull()).alias("left_in"))
    first = chosen.select("person_id", F.col("idx").alias("lead"))
    turned = (
        marked.join(per_person, "person_id").join(first, "person_id", "left")
        .filter("_out IS NULL OR left_in = 0")
        .withColumn("turn", F.pmod(F.col("idx") - F.coalesce("lead", F.lit(0)), F.col("n")))
    )
    if cap is None:
        again = ordered.number_rows(ordered.range_slices(turned.drop(ordered.SLICE), ["person_id"], ["turn"]), ["person_id"], [F.col("turn")], "place")
        return again.select("person_id", "seq", "idx", "place")
    by = Window.partitionBy("person_id").orderBy("turn")
    best = turned.withColumn("place", F.row_number().over(by).cast("long")).filter(F.col("place") <= cap)
    return best.select("person_id", "seq", "idx", "place")


def rebuild_history(outputs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The newest outputs, each path once."""
    rest = [c for c in outputs.columns if c != "path"]
    newest = outputs.groupBy("path").agg(F.max_by(F.struct(*rest), "modified").alias("o")).select("path", "o.*")
    return newest.orderBy(F.desc("modified"), "path").limit(limit)


def sample_per_folder(files: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` files of each folder, the same ones for the same seed.

    The limit reaches below the shuffle, so a huge folder sends on only ``n`` rows per task.
    """
    by = Window.partitionBy("folder").orderBy(md5_order(F.lit(seed), F.col("path")), "path")
    return files.withColumn("draw", F.row_number().over(by)).filter(F.col("draw") <= n)
