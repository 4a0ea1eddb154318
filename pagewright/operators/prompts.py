"""Trigger words into prompts, and the audit of a caption dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words taken from a sidecar, and the shape of a usable output name
SIDECAR_WORDS = 4
OUTPUT_NAME = r"^[A-Za-z][A-Za-z]{0,39}$"


def _first_text(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in candidates])


def with_trigger(prompt: Column, trigger: Column, before: bool = False) -> Column:
    """The prompt with its trigger, unless it holds it already in any case."""
    held = F.contains(F.lower(prompt), F.lower(trigger))
    joined = F.concat_ws(", ", trigger, prompt) if before else F.concat_ws(", ", prompt, trigger)
    return F.when(trigger.isNull() | held, prompt).otherwise(joined)


def trigger_inject(prompts: DataFrame, styles: DataFrame) -> DataFrame:
    """Each prompt with the trigger of its style.

    ``styles`` has (style, sidecar array<string>, trigger_phrase, trigger_words, output_name); the
    first source that holds anything wins. ``prompts`` has (prompt_id, style, map_trigger, prompt);
    the map's own trigger goes in front first, so the style's is not doubled.
    """
    name = F.col("output_name")
    pick = styles.select(
        "style",
        _first_text(
            F.array_join(F.slice(F.coalesce("sidecar", F.array().cast("array<string>")), 1, SIDECAR_WORDS), ", "),
            F.col("trigger_phrase"),
            F.col("trigger_words"),
            F.when(name.rlike(OUTPUT_NAME), name),
        ).alias("style_trigger"),
    )
    led = with_trigger(F.col("prompt"), F.col("map_trigger"), before=True)
    return prompts.join(pick, "style", "left").select(
        "prompt_id", "style", "style_trigger", with_trigger(led, F.col("style_trigger")).alias("full_prompt")
    )


def caption_pair(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Per dataset: images with and without a caption of the same name, captions without an image, size class.

    Both sides have (dataset, path). Join keys are whole stems, so a large dataset spreads evenly.
    """
    def stem(df, side):
        return df.select("dataset", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.lit(1).alias(side))

    both = stem(images, "img").join(stem(captions, "cap"), ["dataset", "stem"], "full_outer")
    n = F.col("paired")
    return both.groupBy("dataset").agg(
        F.count_if(F.col("img").isNotNull() & F.col("cap").isNotNull()).alias("paired"),
        F.count_if(F.col("cap").isNull()).alias("without_caption"),
        F.count_if(F.col("img").isNull()).alias("without_image"),
    ).withColumn(
        "size_class",
        F.when(n < 15, "small").when(n <= 30, "good").when(n < 50, "large").otherwise("excellent"),
    )
