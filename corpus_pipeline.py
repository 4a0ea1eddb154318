"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bloom, jaccard, labelled, packing, positive, queries, subword, winnow
from pagewright.llm.rows import keyed
from pagewright.session import cut, fresh_path

#: A document whose quality score is lower goes.
QUALITY = 0.3
#: A document whose toxicity score is as high goes.
TOXIC = 0.5
#: The key of a row within a stage; ids may be null or repeat.
ROW = "_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Every row is judged for its own text, whatever its id; a null text is scored as an empty one, repeated rows alike. An empty table stays empty.
    """
    return labelled.kept(docs, subword.model(docs, queries.table(spark, sf_dir, "labels")), lambda score: score >= QUALITY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; rows without text, repeated rows and empty tables as in ``quality``."""
    return labelled.kept(docs, positive.model(docs, queries.table(spark, sf_dir, "labels")), lambda score: score < TOXIC)


def rows_of(docs: DataFrame) -> DataFrame:
    """(``ROW``, held): each row of ``docs`` whole in one struct, so that no column of its own meets a name used here, and a key of the row."""
    return keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")), ROW)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): that with the smallest id, and of those the first.

    Rows are judged one by one, so rows of one id, or without an id, go only for their own text; a null id comes after all others.
    Rows without a word, or without text, are near nothing and stay.
    """
    rows = rows_of(docs)
    texts = rows.select(ROW, F.col("held.text").alias("text"))
    groups = jaccard.jaccard_components(texts, k=5, percent=80, id_col=ROW, links=False).select(F.col("doc_id").alias(ROW), "component_id")
    others = cut(groups.filter(F.col("component_id") != F.col(ROW)))
    many = others.unionByName(others.select(F.col("component_id").alias(ROW), "component_id").distinct())  # all rows of groups of several
    ranked = many.join(rows.select(ROW, F.struct(F.col("held.doc_id").isNull(), "held.doc_id", ROW).alias("rank")), ROW)
    stays = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{ROW}").alias(ROW))
    return bloom.without(rows, many.select(ROW).join(stays, ROW, "left_anti"), ROW).select("held.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text shares no window of ten words with the benchmark; each row goes for its own text, whatever its id; rows without a word stay."""
    rows = rows_of(docs)
    hits = winnow.contamination(rows.select(ROW, F.col("held.text").alias("text")), queries.table(spark, sf_dir, "benchmark"), span=10, id_col=ROW).filter("n_hit > 0")
    return bloom.without(rows, hits.select(F.col("doc_id").alias(ROW)), ROW).select("held.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a row without text is one piece of one token, repeated rows are packed each."""
    cuts = packing.pieces(docs, queries.tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return packing.pack(cuts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [
    ("quality", quality), ("toxicity", toxicity), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("pack", pack),
]

#: Trained scores and packing cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder, so a lost executor costs one stage's tasks."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
