"""A kept inverted index of entries, and exact top-k retrieval that reads the postings of rare words only.

An entry's score is the number of a prompt's words that it holds. Let a prompt have ``n`` words that occur at all, from the rarest to the most
frequent. An entry that reaches the score ``s`` shares ``s`` of them, so it must hold one of the first ``n - s + 1``: the postings of the other,
frequent words need not be read. With ``m`` words more it must hold ``1 + m`` of those read, which most entries do not; only those that do are
looked at whole. A score that ``k`` entries are known to reach is found first, from the few rarest words, and fixes how many words are read.

The index is three written tables, good for any number of prompts: ``postings`` (word, block, ids), an entry's words in ``entries``, and ``words``
with their frequencies. A block holds at most ``BLOCK`` entries, so a word in every entry is many rows of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Entries of a block, as a power of two.
BLOCK = 12
#: Words looked at first: at least so many, and on while their entries are fewer than ``POOL`` for each one wanted.
RAREST = 2
POOL = 8
#: Part of the known score that is read in words more.
MORE = 0.5


@dataclass(frozen=True)
class Index:
    """The written tables of an index; ``opened`` reads them again in any session."""

    postings: DataFrame
    entries: DataFrame
    words: DataFrame


def build(entries: DataFrame, path: str) -> Index:
    """Writes the index of ``entries`` (entry_idx, words; words distinct) below ``path``, which must be new."""
    spark = entries.sparkSession
    entries.select("entry_idx", "words").write.parquet(f"{path}/entries")
    kept = spark.read.parquet(f"{path}/entries")
    placed = kept.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK))
    (
        placed.select("block", "entry_idx", F.explode("words").alias("word"))
        .groupBy("word", "block").agg(F.array_sort(F.collect_list("entry_idx")).alias("ids"))
        .sortWithinPartitions("word").write.parquet(f"{path}/postings")
    )
    counted = spark.read.parquet(f"{path}/postings").groupBy("word").agg(F.sum(F.size("ids")).alias("df"))
    counted.write.parquet(f"{path}/words")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "entries", "words")))


def first_entries(index: Index, k: int) -> DataFrame:
    """The first ``k`` entries in entry order."""
    return index.entries.select("entry_idx").orderBy("entry_idx").limit(k)


def _scored(index: Index, candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """(prompt_id, entry_idx, score) of candidate pairs, by the whole word sets."""
    sets = asked.groupBy("prompt_id").agg(F.collect_list("word").alias("asked"))
    return (
        candidates.select("prompt_id", "entry_idx").join(sets, "prompt_id").join(index.entries, "entry_idx")
        .select("prompt_id", "entry_idx", F.size(F.array_intersect("words", "asked")).cast("long").alias("score"))
    )


def _holding(index: Index, asked: DataFrame) -> DataFrame:
    """(prompt_id, entry_idx, part): how many of the given words of a prompt an entry holds."""
    met = index.postings.join(asked.select("prompt_id", "word"), "word")
    return met.select("prompt_id", F.explode("ids").alias("entry_idx")).groupBy("prompt_id", "entry_idx").agg(F.count("*").alias("part"))


def top_scores(index: Index, prompt_words: DataFrame, k: int) -> DataFrame:
    """(prompt_id, entry_idx, score, rank) of the ``k`` best entries of each prompt of (prompt_id, word), equal scores in entry order.

    Entries that share no word are not listed, and a prompt may have fewer than ``k``.
    """
    rare = Window.partitionBy("prompt_id").orderBy("df", "word")
    asked = cut(
        prompt_words.join(index.words, "word")
        .withColumn("pos", F.row_number().over(rare)).withColumn("before", F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.count("*").over(Window.partitionBy("prompt_id")))
    )
    # a score that k entries reach, from the rarest words
    some = _holding(index, asked.filter((F.col("pos") <= RAREST) | (F.col("before") < POOL * k)))
    best = Window.partitionBy("prompt_id").orderBy(F.desc("part"), "entry_idx")
    likely = some.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= POOL * k)
    falling = Window.partitionBy("prompt_id").orderBy(F.desc("score"))
    reached = _scored(index, likely, asked).withColumn("r", F.row_number().over(falling)).filter(F.col("r") == k).select("prompt_id", F.col("score").alias("least"))
    told = cut(asked.join(reached, "prompt_id", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(1)), F.lit(1))))
    # all that can reach it hold 1 + more of the first n - least + 1 + more words
    more = F.least(F.floor(F.col("least") * MORE).cast("long"), F.col("least") - 1)
    read = told.filter(F.col("pos") <= F.col("n") - F.col("least") + 1 + more)
    room = told.select("prompt_id", "least", (1 + more).alias("need")).distinct()
    able = _holding(index, read).join(room, "prompt_id").filter(F.col("part") >= F.col("need"))
    exact = _scored(index, able, asked).join(room, "prompt_id").filter(F.col("score") >= F.col("least"))
    order = Window.partitionBy("prompt_id").orderBy(F.desc("score"), "entry_idx")
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("prompt_id", "entry_idx", "score", "rank")
