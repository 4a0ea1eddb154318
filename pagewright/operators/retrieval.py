"""Keyword retrieval over example maps: score, rank, fall back, draw and thin near-duplicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order, words
from ..functions.vectors import cosine_unit
from ..session import cut, is_empty
from . import index as kept_index

# fixed values: defaults of a map and of its near-duplicate rule
TOP_K = 4
NEAR_DUPLICATE = 0.97
DRAW_POOL_PER_K = 8
#: Pairs of a prompt and an entry that a task may come to count.
PAIRS_A_TASK = 1 << 19
#: Entries and prompts that a task of a walk holds at once.
WALK_ENTRIES, WALK_PROMPTS = 1 << 11, 1 << 10


def entry_words(entries: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Entries with a ``words`` column: keywords when there are any, and the caption's words."""
    tags = F.array_join(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), " ")
    return entries.withColumn(
        "words", words(F.concat_ws(" ", tags, F.col("caption")), stop_words)
    )


def prompt_words(prompts: DataFrame) -> DataFrame:
    """(prompt_id, word): the set of words of each prompt."""
    return prompts.select("prompt_id", F.explode(words(F.col("text"))).alias("word"))


def postings(entries: DataFrame) -> DataFrame:
    """(word, entry_idx): the inverted index. ``words`` holds distinct words."""
    return entries.select(F.explode("words").alias("word"), "entry_idx")


def retrieve_join(entries: DataFrame, prompts: DataFrame, require_ref: bool = False) -> DataFrame:
    """(prompt_id, entry_idx, word) for every word a prompt and an entry share.

    No broadcast is forced: the prompt side goes out whole only while it is under Spark's
    own size threshold; beyond it the join shuffles on the word and AQE splits hot words.
    Entries are dealt by number first, so pairs counted by entry stay where they are while prompts go out whole.
    """
    eligible = entries.filter("has_ref") if require_ref else entries
    return postings(_dealt(eligible, prompts)).join(prompt_words(prompts), "word").select(
        "prompt_id", "entry_idx", "word"
    )


def _dealt(entries: DataFrame, prompts: DataFrame) -> DataFrame:
    """Entries over tasks that grow with the pairs they can make. AQE sizes tasks by compressed bytes, of which few make millions of pairs."""
    spark = entries.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-entries.count() * prompts.count() // PAIRS_A_TASK))
    # one more than the shuffle partitions, since Spark drops a repartition that equals the one before it
    return entries.select("entry_idx", "words").repartition(parts + (parts == int(spark.conf.get("spark.sql.shuffle.partitions"))), "entry_idx")


def keyword_score(matches: DataFrame) -> DataFrame:
    """Score = number of distinct entry words present in the prompt.

    ``matches`` has one row per shared word already, so a plain count is exact. Matches that still lie with
    their entry are not shuffled, others combine before the shuffle.
    """
    return matches.groupBy("prompt_id", "entry_idx").agg(F.count("*").alias("score"))


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``rank``: score descending, entry order on ties. A limit is applied before the shuffle."""
    by = Window.partitionBy("prompt_id").orderBy(F.desc("score"), "entry_idx")
    out = scores.withColumn("rank", F.row_number().over(by))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def _or_first(first: DataFrame, prompts: DataFrame, best: DataFrame) -> DataFrame:
    """``best`` with the entries of ``first`` for every prompt it says nothing about.

    The prompts are laid over the result once, so scoring is not run a second time to find who went without.
    """
    cols = [c for c in best.columns if c != "prompt_id"]
    first = first.agg(F.array_sort(F.collect_list("entry_idx")))

    def instead(entry, pos):
        values = {"entry_idx": entry, "score": F.lit(0).cast("long")}
        return F.struct(*[values.get(c, pos + 1).alias(c) for c in cols])

    laid = prompts.select("prompt_id").join(best, "prompt_id", "left").withColumn("_first", first.scalar())
    rows = F.when(F.col("entry_idx").isNotNull(), F.array(F.struct(*cols))).otherwise(F.transform("_first", instead))
    return laid.select("prompt_id", F.explode(rows).alias("r")).select("prompt_id", "r.*")


def _first(entries: DataFrame, k: int, require_ref: bool) -> DataFrame:
    eligible = entries.filter("has_ref") if require_ref else entries
    return eligible.select("entry_idx").orderBy("entry_idx").limit(k)


def topk_from(index: kept_index.Index, prompts: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best ``k`` entries of a kept index (``index.build``, ``index.opened``) per prompt; a prompt that matches nothing gets the first ``k``."""
    best = kept_index.top_scores(index, prompt_words(prompts), k)
    return _or_first(kept_index.first_entries(index, k), prompts, best)


def retrieve_topk(entries: DataFrame, prompts: DataFrame, k: int = TOP_K, require_ref: bool = True) -> DataFrame:
    """The best ``k`` entries per prompt; a prompt that matches nothing gets the first ``k``.

    For prompts that come once: every posting of their words is counted. Where prompts keep coming, ``topk_from`` a kept index reads far fewer.
    """
    scores = keyword_score(retrieve_join(entries, prompts, require_ref))
    best = ranked(scores, k).select("prompt_id", "entry_idx", "score", "rank")
    return _or_first(_first(entries, k, require_ref), prompts, best)


def walk_score(entries: DataFrame, prompts: DataFrame) -> DataFrame:
    """The same score without the index: every prompt walks over every entry and compares the two word sets.

    All pairs by nature. A task holds one stretch of entries and one of prompts at a time and gives out only pairs that share a word; no
    candidates are taken from ``retrieve_join``, so a pair that the index misses is found here.
    """
    e, p = entries.select("entry_idx", "words"), prompts.select("prompt_id", words(F.col("text")).alias("asked"))
    tall, wide = (max(1, -(-df.count() // most)) for df, most in ((e, WALK_ENTRIES), (p, WALK_PROMPTS)))

    def dealt(df, key, own, n, other, m):
        stretch = F.expr(f"cast(pmod(xxhash64({key}), {n}) AS int)").alias(own)
        return df.select("*", stretch, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).groupBy("_tall", "_wide")

    kinds = dict(e.dtypes) | dict(p.dtypes)
    return dealt(e, "entry_idx", "_tall", tall, "_wide", wide).cogroup(dealt(p, "prompt_id", "_wide", wide, "_tall", tall)).applyInArrow(
        _walk, f"prompt_id {kinds['prompt_id']}, entry_idx {kinds['entry_idx']}, score bigint")


def _walk(entries: pa.Table, prompts: pa.Table) -> pa.Table:
    asked = [frozenset(a or ()) for a in prompts["asked"].to_pylist()]
    rows, cols, scores = [], [], []
    for i, have in enumerate(entries["words"].to_pylist()):
        have = frozenset(have or ())
        shared = [len(have & a) for a in asked]
        hit = [j for j, n in enumerate(shared) if n]
        rows += [i] * len(hit)
        cols += hit
        scores += [shared[j] for j in hit]
    return pa.table({
        "prompt_id": prompts["prompt_id"].take(pa.array(cols, pa.int64())), "entry_idx": entries["entry_idx"].take(pa.array(rows, pa.int64())),
        "score": pa.array(scores, pa.int64())})


def side_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of two results, with ``n_left`` and ``n_right``: how often each has them.

    One count over both, so each result is worked out once.
    """
    cols = left.columns
    both = left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionAll(right.select(*cols).withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
    return both.groupBy(*cols).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))


def rows_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found in one of two results only, tagged with the side that has them, as often as that side has more of them."""
    more = side_counts(left, right).withColumn("_n", F.col("n_left") - F.col("n_right")).filter("_n <> 0")
    return more.select(*left.columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_n")))).drop("col")


def seeded_draw(entries: DataFrame, prompts: DataFrame, seed: int, k: int = TOP_K, require_ref: bool = True) -> DataFrame:
    """``k`` entries drawn from the ``8 k`` strongest matches: same seed, same set."""
    scores = keyword_score(retrieve_join(entries, prompts, require_ref))
    pool = ranked(scores, DRAW_POOL_PER_K * k)
    by = Window.partitionBy("prompt_id").orderBy(
        md5_order(F.lit(seed), F.col("prompt_id"), F.col("entry_idx")), "entry_idx"
    )
    drawn = pool.withColumn("draw", F.row_number().over(by)).filter(F.col("draw") <= k)
    return _or_first(_first(entries, k, require_ref), prompts, drawn.select("prompt_id", "entry_idx", "score", "rank", "draw"))


def _keep(kept: Column, nxt: Column, k: int, limit: float) -> Column:
    fits = (F.size(kept) < k) & (
        nxt["e"].isNull() | ~F.exists(kept, lambda q: F.coalesce(cosine_unit(q["e"], nxt["e"]) > limit, F.lit(False)))
    )
    return F.when(fits, F.array_append(kept, nxt)).otherwise(kept)


def _last_ranks(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("prompt_id").agg(F.max("rank").alias("last"))


def near_dup_thin(
    ranking: DataFrame, vectors: DataFrame, k: int = TOP_K, limit: float = NEAR_DUPLICATE, pool: int | None = None
) -> DataFrame:
    """Walk each prompt's ranking, passing over an entry too close to one already kept.

    ``ranking`` has (prompt_id, entry_idx, rank), ``vectors`` (entry_idx, e) of unit length. The
    walk takes a slice of ranks at a time, always of one size, and carries at most ``k`` kept vectors, so no
    task ever holds more of a ranking than a slice; prompts still short of ``k`` go on with the next slice until
    their ranking is exhausted, which keeps the result exact. What the first slice can look at is worked out by itself, so that a window over
    the ranking is limited below its shuffle; the rest is worked out once, for the prompts that go on.
    """
    step = pool or DRAW_POOL_PER_K * k
    # keep only what a slice can look at before vectors are attached
    state = None
    low = 0
    ranking = ranking.select("prompt_id", "entry_idx", "rank")
    # one rank more tells whose ranking goes on
    todo = cut(ranking.filter(F.col("rank") <= step + 1))
    longest = cut(_last_ranks(todo))
    done = None
    item = "struct<rank:int,entry_idx:bigint,e:array<double>>"
    while True:
        part = todo.filter((F.col("rank") > low) & (F.col("rank") <= low + step))
        if state is not None:
            part = part.join(state.select("prompt_id"), "prompt_id", "left_semi")
        lists = (
            part.join(vectors.select("entry_idx", "e"), "entry_idx", "left")
            .groupBy("prompt_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "entry_idx", "e"))).cast(f"array<{item}>").alias("items"))
        )
        if state is None:
            start = lists.withColumn("kept", F.array().cast(f"array<{item}>"))
        else:
            start = lists.join(state, "prompt_id")
        walked = start.select(
            "prompt_id",
            F.aggregate("items", F.col("kept"), lambda acc, n: _keep(acc, n, k, limit)).alias("kept"),
        )
        walked = cut(walked.join(longest, "prompt_id"))
        low += step
        short = (F.size("kept") < k) & (F.col("last") > low)
        finished = walked.filter(~short).select("prompt_id", "kept")
        done = finished if done is None else done.unionByName(finished)
        state = walked.filter(short).select("prompt_id", "kept")
        if is_empty(state):
            break
        if low == step:
            todo = cut(ranking.filter(F.col("rank") > step).join(state.select("prompt_id"), "prompt_id", "left_semi"))
            longest = cut(_last_ranks(todo))
    return done.select("prompt_id", F.posexplode("kept").alias("pos", "item")).select(
        "prompt_id", F.col("item.entry_idx").alias("entry_idx"),
        F.col("item.rank").alias("rank"), (F.col("pos") + 1).alias("place"),
    )


def near_dup_pairs(
    ranking: DataFrame, vectors: DataFrame, k: int = TOP_K, limit: float = NEAR_DUPLICATE, pool: int | None = None
) -> DataFrame:
    """(prompt_id, entry_idx, rank, kept_idx, cosine): every entry the walk passed over and the kept one it repeats.

    Only kept entries, at most ``k`` per prompt, are compared with others, so a heap of copies costs one row each and
    never the pairs among themselves.
    """
    kept = cut(near_dup_thin(ranking, vectors, k, limit, pool))
    e = vectors.select("entry_idx", "e")
    # a walk that found k entries ends at the last of them, any other at the end of its ranking
    ends = kept.groupBy("prompt_id").agg(F.when(F.count("*") >= k, F.max("rank")).alias("end"))
    passed = (
        ranking.select("prompt_id", "entry_idx", "rank").join(ends, "prompt_id").filter("end IS NULL OR rank < end")
        .join(kept.select("prompt_id", "entry_idx"), ["prompt_id", "entry_idx"], "left_anti").join(e, "entry_idx")
    )
    have = kept.join(e, "entry_idx").groupBy("prompt_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "entry_idx", "e"))).alias("kept"))
    near = F.element_at(F.filter(
        F.transform("kept", lambda q: F.struct(q["rank"].alias("rank"), q["entry_idx"].alias("kept_idx"), cosine_unit(q["e"], F.col("e")).alias("cosine"))),
        lambda q: (q["cosine"] > limit) & (q["rank"] < F.col("rank"))), 1)
    return passed.join(have, "prompt_id").withColumn("n", near).select(
        "prompt_id", "entry_idx", "rank", "n.kept_idx", "n.cosine")
