"""Quality rules by host, in DataFrame functions only.

Every document is measured and put to base rules; failures are added up per host; a host's failure rate is shrunk towards
the corpus by a beta prior fitted to the host rates by moments; hosts whose shrunk rate is too high are turned down
and the verdict is joined back. A host with a third of all rows is one number per map task before the shuffle, and the join back is
skewed at most on the documents' side, which Spark splits.

Results: null texts have no words; a null host is a host of its own; documents that repeat count each; an empty table
gives an empty result; without spread between hosts the prior is so strong that every host has the corpus rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A host is turned down when its shrunk failure rate is above this.
MOST_FAILED = 0.5
#: Bounds of the strength (a + b) of the prior, in documents.
STRENGTH = (2.0, 10_000.0)
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words of a text that lie in a ``window``-word window found twice or more in it."""

    def marked(hits: Column) -> Column:
        # hits: sorted (hash, place); places next to an equal hash, then how far each reaches before the next place
        shared = lambda x, i: F.coalesce(F.get(hits, i)["h"] == x["h"], F.lit(False))
        same = F.filter(hits, lambda x, i: shared(x, i - 1) | shared(x, i + 1))
        places = F.array_sort(F.transform(same, lambda x: x["at"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    grams = _let(words, lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, window)]).alias("h"), i.alias("at"))))
    return _let(F.array_sort(grams), marked)


def measured(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    long = lambda c: c.cast("long")
    return documents.withColumns({
        "word_chars": long(F.length(bare)),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_dup_lines": long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "_counts": _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))),
    }).withColumn("n_words", long(F.col("_counts.n"))).withColumn("n_repeat_words", long(F.col("_counts.r"))).drop("_counts")


def host_verdicts(judged: DataFrame, host: str, failed: str, most: float = MOST_FAILED) -> DataFrame:
    """(host, n, n_failed, rate, host_failed): failure rates shrunk by a beta prior fitted by moments to the host rates."""
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    p = F.sum("n_failed") / F.sum("n")
    # the spread of rates between hosts beyond what chance gives
    fit = hosts.agg(
        p.alias("mean"), F.var_pop(F.col("n_failed") / F.col("n")).alias("spread"), F.avg(1 / F.col("n")).alias("inverse"))
    room = F.col("mean") * (1 - F.col("mean"))
    between = F.col("spread") - room * F.col("inverse")
    strength = F.when(between > 0, F.least(F.greatest(room / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
    prior = fit.select(F.struct(F.col("mean"), strength.alias("strength")).alias("p"))
    rate = (F.col("n_failed") + F.col("_p.mean") * F.col("_p.strength")) / (F.col("n") + F.col("_p.strength"))
    return hosts.withColumn("_p", prior.scalar()).withColumn("rate", rate).withColumn("host_failed", F.col("rate") > most).drop("_p")


def quality_verdicts(documents: DataFrame, host: str = "source", most: float = MOST_FAILED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, the measures, base_failed, host_rate, host_failed, kept) per row."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text_col).alias("text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = cut(measured(docs).drop("text").withColumn("base_failed", base))  # texts are read once, for the rates and for the rows
    verdict = host_verdicts(judged, "host", "base_failed", most).select(
        F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_failed")
    return judged.join(verdict, F.col("host").eqNullSafe(F.col("_host"))).drop("_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
