"""Paid answers: keys, lookup, batch planning, storing and what it all costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import request_key as key_of

# fixed values: price of an unknown model in USD per million tokens, and of special tokens
DEFAULT_PRICE_IN = 4.0
DEFAULT_PRICE_OUT = 20.0
DEFAULT_CACHE_READ = 0.2
CACHE_WRITE_FACTOR = 1.25
BATCH_FACTOR = 0.5
LOCAL_PREFIX = "ollama:"
REFUSAL = "refusal"
# fixed values: reading of a quality reply
SCORE_TOP = 10
SCORE_PASS = 7
ISSUE_CHARS = 160

USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def request_key(requests: DataFrame) -> DataFrame:
    """Adds ``key``, the hash of everything in ``payload`` that shapes the answer."""
    return requests.withColumn("key", key_of(F.col("payload")))


def cache_lookup(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with ``hit`` and the stored text; a hit uses no tokens.

    Answers have one row per key, so a request repeated very often only makes the left side of
    the join heavy, which AQE splits.
    """
    stored = answers.select("key", F.col("text").alias("answer"), F.lit(True).alias("found"))
    hit = F.coalesce("found", F.lit(False))
    free = [F.when(hit, F.lit(0)).otherwise(F.col(u)).cast("long").alias(u) for u in USAGE if u in requests.columns]
    kept = [c for c in requests.columns if c not in USAGE]
    return requests.join(stored, "key", "left").select(*kept, hit.alias("hit"), "answer", *free)


def batch_plan(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per distinct key not stored yet: its first request, ordered by ``first_seq``.

    The first request is an aggregate, not a window: repeats collapse before the shuffle.
    """
    rest = [c for c in requests.columns if c not in ("key", "seq")]
    first = requests.groupBy("key").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("asked"),
        *[F.min_by(c, "seq").alias(c) for c in rest],
    )
    return first.join(answers.select("key"), "key", "left_anti")


def latest(rows: DataFrame) -> DataFrame:
    """The newest ``version`` of every (kind, key)."""
    rest = [c for c in rows.columns if c not in ("kind", "key", "version")]
    return rows.groupBy("kind", "key").agg(
        F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("last")
    ).select("kind", "key", "version", "last.*")


def answer_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with new answers laid over it: the last version wins, refusals are never kept."""
    kept = new.filter(~F.col("stop_reason").eqNullSafe(REFUSAL))
    return latest(store.unionByName(kept, allowMissingColumns=True))


def price_join(usage: DataFrame, prices: DataFrame, batch: Column | None = None) -> DataFrame:
    """Adds ``cost`` in USD. Unknown models get the default price, local ones are free, batches half.

    ``prices`` (model, price_in, price_out, price_cache_read) is small; Spark broadcasts it while
    its size says so.
    """
    million = F.lit(1_000_000.0)
    n = {u: F.coalesce(F.col(u), F.lit(0)) for u in USAGE}
    p_in = F.coalesce("price_in", F.lit(DEFAULT_PRICE_IN))
    p_out = F.coalesce("price_out", F.lit(DEFAULT_PRICE_OUT))
    p_read = F.coalesce("price_cache_read", F.lit(DEFAULT_CACHE_READ))
    full = (
        n["input_tokens"] * p_in
        + n["cache_creation_input_tokens"] * p_in * CACHE_WRITE_FACTOR
        + n["cache_read_input_tokens"] * p_read
        + n["output_tokens"] * p_out
    ) / million
    factor = F.lit(1.0) if batch is None else F.when(batch, BATCH_FACTOR).otherwise(1.0)
    cost = F.when(F.startswith(F.col("model"), F.lit(LOCAL_PREFIX)), 0.0).otherwise(full * factor)
    return usage.join(prices, "model", "left").withColumn("cost", cost).drop(
        "price_in", "price_out", "price_cache_read"
    )


def cache_stats(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    )


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Cost, calls and pieces per (sheet, source), per sheet and in all; ``level`` says which."""
    return calls.rollup("sheet", "source").agg(
        F.sum("cost").alias("cost"), F.count("*").alias("calls"), F.sum("pieces").alias("pieces"),
        F.grouping_id().cast("int").alias("level"),
    )


def read_reply(text: Column) -> tuple[Column, Column]:
    """(score, issue) of one reply: the object from the first ``{`` to the last ``}``."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1))
    valid = F.try_parse_json(body).isNotNull()
    raw = F.get_json_object(body, "$.score").try_cast("double")
    score = F.when(valid, F.greatest(F.lit(0), F.least(F.lit(SCORE_TOP), F.bround(raw).cast("int"))))
    score = F.when(raw.isNotNull(), score)
    issue = F.when(score.isNotNull(), F.substring(F.coalesce(F.get_json_object(body, "$.issue"), F.lit("")), 1, ISSUE_CHARS))
    return score, issue


def reply_scores(replies: DataFrame) -> DataFrame:
    """(sheet, reply_id, score, issue); an unreadable reply has no score."""
    score, issue = read_reply(F.col("text"))
    return replies.select("sheet", "reply_id", score.alias("score"), issue.alias("issue"))


def reply_summary(scores: DataFrame) -> DataFrame:
    """Per sheet: share of readable replies, mean score and how many fall short."""
    return scores.groupBy("sheet").agg(
        F.count("*").alias("replies"),
        F.avg(F.col("score").isNotNull().cast("int")).alias("readable"),
        F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") < SCORE_PASS).alias("low"),
    )


def answer_fn(
    requests: DataFrame, store: DataFrame, ask: Callable[[pd.DataFrame], pd.DataFrame], version: int
) -> DataFrame:
    """Sends what is not stored yet through ``ask`` once per key; returns the store with the answers in it.

    ``ask`` gets a batch with (key, payload) and returns (key, text, stop_reason, model). A task that
    runs twice asks twice but stores once, because answers are keyed. Save the result before
    looking requests up in it, so the calls are not repeated.
    """
    todo = batch_plan(requests, store).select("kind", "key", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                said = ask(batch[["key", "payload"]])[["key", "text", "stop_reason", "model"]]
                yield batch[["kind", "key"]].merge(said, on="key")

    got = todo.mapInPandas(run, "kind string, key string, text string, stop_reason string, model string")
    return answer_upsert(store, got.withColumn("version", F.lit(version).cast("long")))


def first_result(results: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source tag) of the first non-null result in order."""
    value = F.coalesce(*[c for _, c in results])
    tag = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in results])
    return value, tag


def piece_fns(pieces: DataFrame, fns: list[tuple[str, Callable[..., Column]]], *inputs: str) -> DataFrame:
    """Runs drawing functions in order of preference; the first that returns something wins.

    Each is a column function (built-in expression or pandas UDF) over ``inputs``. ``drawn`` holds the
    winning result and ``method`` its name; pieces none can draw keep nulls.
    """
    value, tag = first_result([(name, fn(*[F.col(i) for i in inputs])) for name, fn in fns])
    return pieces.withColumn("drawn", value).withColumn("method", tag)
