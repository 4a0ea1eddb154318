"""Benchmark decontamination by winnowing.

Every text is cut into overlapping ``GRAM``-word grams; of each ``WINDOW`` consecutive gram hashes the smallest (the
rightmost of equals) is kept as a fingerprint. A shared run of ``span = GRAM + WINDOW - 1`` words has the same
window in both texts and so the same fingerprint: no shared run of ``span`` words is missed. Fingerprints of
documents and items are joined and every hit is extended word by word to both sides; a run of at least
``span`` words counts. An item of fewer than ``span`` words is one window: all of the document's grams of that length are
fingerprints for it.

Scale: documents never move. A fixed-size Bloom filter of the items' fingerprints is broadcast, so only
document fingerprints that (almost surely) occur in an item are shuffled, each with the words around it. Item
contexts are joined distinct, so a passage held by many items meets each document place once.

Results: null or wordless texts have no words and no hits; wordless items never occur; rows that repeat a
``doc_id`` (null included) keep their own word count and pool their hits; a repeated item id counts once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import bloom
from .arrow import as_bytes, binaries, lists, over_batches
from .words import SpanHash, grams, letters_and_digits, lower_table, mix, spans, text_blocks

GRAM = 5


class Winnower:
    """Words and fingerprints of the texts of a block."""

    def __init__(self, span: int, gram: int = GRAM):
        self.span, self.gram, self.window = span, gram, span - gram + 1
        self.lower, self.table, self.hasher = lower_table(), letters_and_digits(), SpanHash(2)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.lower[data]
        s, e, text = spans(low, bounds, self.table)
        return (self.hasher.of(self.hasher.sums(low), s, e) if len(s) else np.zeros(0, np.uint64)), text

    def fingerprints(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first words) of the grams that winnowing keeps."""
        h, at = grams(words, text, self.gram)
        w = self.window
        if len(h) < w:
            return h[:0], at[:0]
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        low = np.flatnonzero(text[at[:len(view)]] == text[at[w - 1:]])
        least = low + (w - 1 - view[low, ::-1].argmin(axis=1))
        keep = np.unique(least)
        return h[keep], at[keep]

    def around(self, words: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Word hashes from ``window - 1`` before each gram to as many after it; 0 beyond the text's ends."""
        r = self.window - 1
        place = at[:, None] + np.arange(-r, self.gram + r)
        inside = (place >= 0) & (place < len(words))
        place = np.clip(place, 0, max(0, len(words) - 1))
        return np.where(inside & (text[place] == text[at][:, None]), words[place], np.uint64(0))


def _whole(gram: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of a short item, apart from those of other lengths."""
    return mix(gram ^ np.uint64(0xA5A5 + length))


def _items(items: DataFrame, span: int) -> DataFrame:
    """(fp, short, context, item) per fingerprint of every item; ``short`` is the length of an item below ``span``, else 0."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Winnower(span)
        for b in batches:
            for row, data, bounds in text_blocks(b.column("text")):
                words, text = w.words(data, bounds)
                fp, at = w.fingerprints(words, text)
                ctx = w.around(words, text, at) if len(at) else np.zeros((0, 2 * w.window + w.gram - 2), np.uint64)
                fps, shorts, owners = [fp], [np.zeros(len(fp), np.int32)], [text[at]]
                ctxs = [ctx]
                count = np.bincount(text, minlength=len(bounds) - 1)
                for m in np.unique(count[(count > 0) & (count < span)]):
                    g, where = grams(words, text, int(m))
                    where, g = where[count[text[where]] == m], g[count[text[where]] == m]
                    fps.append(_whole(g, int(m)))
                    shorts.append(np.full(len(g), m, np.int32))
                    owners.append(text[where])
                    ctxs.append(np.zeros((len(g), ctx.shape[1]), np.uint64))
                fp, ctx = np.concatenate(fps), np.concatenate(ctxs)
                owner = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays([
                    pa.array(fp.view(np.int64)), pa.array(np.concatenate(shorts)),
                    binaries(ctx.view(np.uint8).ravel(), np.full(len(fp), ctx.shape[1] * 8)),
                    b.column("item").slice(row, len(bounds) - 1).take(pa.array(owner)),
                ], ["fp", "short", "context", "item"])

    return over_batches(items, read, "fp long, short int, context binary, item string")


def _documents(docs: DataFrame, span: int, filled: np.ndarray, lengths: list[int]) -> DataFrame:
    """(doc_id, n_words, fps, at, contexts) per document: the fingerprints that may occur in an item."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Winnower(span)
        for b in batches:
            for row, data, bounds in text_blocks(b.column("text")):
                n = len(bounds) - 1
                words, text = w.words(data, bounds)
                count = np.bincount(text, minlength=n)
                first = np.concatenate([[0], np.cumsum(count)])[:-1]
                fp, at = w.fingerprints(words, text)
                ok = bloom.holds(sent.value, fp)
                fps, ats = [fp[ok]], [at[ok]]
                for m in lengths:
                    g, where = grams(words, text, m)
                    g = _whole(g, m)
                    ok = bloom.holds(sent.value, g)
                    fps.append(g[ok])
                    ats.append(where[ok])
                fp, at = np.concatenate(fps), np.concatenate(ats)
                order = np.lexsort((at, text[at]))
                fp, at = fp[order], at[order]
                ctx = w.around(words, text, at) if len(at) else np.zeros((0, 1), np.uint64)
                size = np.bincount(text[at], minlength=n)
                here = np.concatenate([[0], np.cumsum(size)])
                wide = 8 * (2 * w.window + w.gram - 2)
                flat = binaries(ctx.view(np.uint8).ravel(), np.full(len(at), wide))
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(row, n), pa.array(count.astype(np.int64)),
                    lists(fp.view(np.int64), size, pa.int64()), lists(at - first[text[at]], size, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(here.astype(np.int32)), flat),
                ], ["doc_id", "n_words", "fps", "at", "contexts"])

    return over_batches(docs, read, "doc_id long, n_words long, fps array<long>, at array<long>, contexts array<binary>")


def _extended(joined: DataFrame, span: int) -> DataFrame:
    """(doc_id, fp, short, context, start, end): joined fingerprints grown to runs of at least ``span`` words."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, gram = span - GRAM, GRAM
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("seen", "context"))
            same = (x == y) & (x != 0)
            core = same[:, reach:reach + gram].all(axis=1)
            left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, reach + gram:], axis=1).sum(axis=1)
            at, short = b.column("at").to_numpy(), b.column("short").to_numpy()
            whole = short > 0
            start = np.where(whole, at, at - left)
            end = np.where(whole, at + short, at + gram + right)
            ok = whole | (core & (end - start >= span))
            got = b.select(["doc_id", "fp", "short", "context"])
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(start), pa.array(end)], [*got.schema.names, "start", "end"]).filter(pa.array(ok))

    return over_batches(joined, grow, "doc_id long, fp long, short int, context binary, start long, end long")


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) per row of ``documents``.

    ``spans`` are the (start, end) runs of hit words, ends outside, disjoint; ``items`` the ids (as strings, sorted) of items with a window in the text.
    """
    index = cut(_items(benchmark.select(F.col(item_col).cast("string").alias("item"), as_bytes(item_text, "text")), span).distinct())
    lengths = [r["short"] for r in index.filter("short > 0").select("short").distinct().collect()]  # fewer than ``span`` numbers
    filled = bloom.build(index, "fp")
    base = cut(_documents(documents.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col, "text")), span, filled, sorted(lengths)))
    found = base.select("doc_id", F.explode(F.arrays_zip("fps", "at", "contexts")).alias("h")).select(
        "doc_id", F.col("h.fps").alias("fp"), F.col("h.at").alias("at"), F.col("h.contexts").alias("seen"))
    hits = cut(_extended(found.join(index.select("fp", "short", "context").distinct(), "fp"), span))
    # words that are hit: runs that overlap or touch are one
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    runs = (
        hits.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
        .withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("run", F.sum(F.expr("CASE WHEN reach >= start THEN 0 ELSE 1 END")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("doc_id").agg(F.sum(F.expr("`end` - start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    items = (
        hits.select("doc_id", "fp", "short", "context").distinct()
        .join(index, ["fp", "short", "context"]).select("doc_id", "item").distinct()
        .groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    got = runs.join(items, runs["doc_id"].eqNullSafe(items["doc_id"])).select(runs["doc_id"].alias("hit_id"), "n_hit", "spans", "items")
    words = base.select("doc_id", "n_words")
    return words.join(got, words["doc_id"].eqNullSafe(got["hit_id"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))
