"""Removal of byte strings that occur twice, by bucket-pointer refinement of a sparse suffix array.

Of all suffixes only those at *anchors* are held: the 32-byte gram with the smallest identifier among the grams of a window of
``span`` bytes, the leftmost of equals. Equal windows have their anchor at the same offset, and an anchor speaks for a run of
windows, so about one suffix in 85 is kept and no repeat is missed.

1. *Initial buckets*: suffixes with one gram identifier. A count over the corpus tells the identifiers that occur twice; a filter of
   fixed size lets only their suffixes go on.
2. *Refinement*: the suffixes of a bucket are told apart by the identifiers of the grams at later offsets of all the windows they
   speak for (a name of 128 bits). What has an equal in its bucket is settled: all its windows occur twice. What is alone in a bucket of
   several names is split into a thirteenth of its windows each, whose common bytes, longer than before, are the next buckets; then again,
   down to single windows. Identifiers are worked out once a scan and every round refines by them.
3. A round is an aggregation by (bucket, name) with one speaker for all equals, so equals are never paired, and one semi-join back.

Documents are read again for each round instead of being moved; only rows of fixed size are shuffled, and in the end the texts that lose bytes.

Defined results: a null text is empty; empty and short texts (under ``span`` bytes) lose nothing; equal rows are documents of their own, so each
repeats the other; null and repeated ids stay, one result per row; other columns are ignored; an empty table gives an empty result. Texts
of any length are worked through in pieces of ``BLOCK`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import bloom
from .arrow import as_bytes, over_batches
from .rows import KEY, keyed
from .words import mix, text_blocks

#: Bytes of a gram.
GRAM = 32
#: Windows of a text that are worked through at once.
BLOCK = 1 << 18
#: Bits of the filters of buckets and speakers: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Parts that a run of windows is split into at a round.
SPLIT = 13
_BASE, _GOLD, _OTHER = 0xD6E8FEB86659FD93 | 1, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def identifiers(data: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of the gram at each place; each doubling joins the strings of half the length."""
    ids = _BYTES[data]
    d = 1
    while d < GRAM:
        ids = ids[:-d] * np.uint64(pow(_BASE, d, 1 << 64)) + ids[d:]
        d *= 2
    return mix(ids)


def minima(ids: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest identifier (upper half; leftmost of equals) among ``width`` from each place on."""
    m = (ids & _HIGH) | np.arange(len(ids), dtype=np.uint64)
    d = 1
    while 2 * d <= width:
        m = np.minimum(m[:-d], m[d:])
        d *= 2
    if d < width:
        m = np.minimum(m[:d - width], m[width - d:])
    return (m & _LOW).astype(np.int64)


class Runs:
    """Runs of windows that share an anchor, in a block of texts: first and last window, anchor, text number; ``base`` places a piece in its text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, span: int, base: int = 0):
        self.span, self.base, self.begin = span, base, bounds
        if len(data) < span:
            self.first = self.last = self.anchor = self.text = np.zeros(0, np.int64)
            return
        self.ids = identifiers(data)
        at = minima(self.ids, span - GRAM + 1)
        lengths = np.diff(bounds)
        full = np.flatnonzero(lengths >= span)
        change = np.zeros(len(at) + 1, np.int32)
        np.add.at(change, bounds[full], 1)
        np.add.at(change, bounds[full] + lengths[full] - span + 1, -1)
        valid = np.cumsum(change[:-1]) > 0
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        self.first = np.flatnonzero(new)
        end = valid.copy()
        end[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
        self.last = np.flatnonzero(end)
        self.anchor = at[self.first]
        self.text = np.searchsorted(bounds, self.first, side="right") - 1

    def take(self, keep: np.ndarray) -> Runs:
        self.first, self.last, self.anchor, self.text = self.first[keep], self.last[keep], self.anchor[keep], self.text[keep]
        return self

    def places(self) -> np.ndarray:
        """First window within its text and how many follow, as one number."""
        return ((self.first - self.begin[self.text] + self.base) << 8) | (self.last - self.first)

    def split(self, width: int) -> Runs:
        """Cut into the parts of ``width`` windows by offset from the anchor; parts of two runs of equal bytes meet at equal offsets."""
        near, far = (self.anchor - self.last) // width, (self.anchor - self.first) // width
        count = far - near + 1
        of = np.repeat(np.arange(len(count)), count)
        part = near[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        first = np.maximum(self.first[of], self.anchor[of] - part * width - width + 1)
        last = np.minimum(self.last[of], self.anchor[of] - part * width)
        self.first, self.last, self.anchor, self.text = first, last, self.anchor[of], self.text[of]
        return self

    def fold(self, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of the bytes from ``start`` to ``end``: the identifiers of the grams at later offsets, joined in order."""
        x = mix(more.astype(np.uint64) + _OTHER * (end - start).astype(np.uint64))
        y = mix(x + _OTHER)
        for step in range(0, int((end - start).max(initial=0)), GRAM):
            here = self.ids[np.minimum(start + step, end - GRAM)]
            on = start + step < end  # a name must not depend on longer neighbours
            x, y = np.where(on, mix(x * _GOLD + here), x), np.where(on, mix(y * _OTHER + (here ^ _GOLD)), y)
        return x, y

    def buckets(self, width: int) -> np.ndarray:
        """Identifiers of the bytes that all windows of a part of ``width`` have in common, clipped or not."""
        part = (self.anchor - self.first) // width
        start = self.anchor - part * width
        return self.fold(start, start - width + 1 + self.span, part)[0]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of all the bytes of a run's windows and of their place about the anchor."""
        return self.fold(self.first, self.last + self.span, ((self.anchor - self.first) << 8) | (self.last - self.first))


def _pieces(b: pa.RecordBatch, span: int):
    """(first row, runs) of a batch, long texts in pieces whose windows do not overlap."""
    for row, data, bounds in text_blocks(b.column("text"), BLOCK):
        if len(bounds) > 2:
            yield row, Runs(data, bounds, span)
        else:
            for at in range(0, max(1, len(data) - span + 1), BLOCK):
                piece = data[at:at + BLOCK + span - 1]
                yield row, Runs(piece, np.array([0, len(piece)]), span, at)


def instance(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of a run of windows of a text."""
    return mix(mix(keys.view(np.uint64) + _GOLD) ^ (places.astype(np.uint64) * _OTHER)).view(np.int64)


def _repeated(docs: DataFrame, span: int) -> np.ndarray | None:
    """A filter of the gram identifiers that anchor two suffixes or more."""
    width = span - GRAM + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, np.uint64), *(runs.buckets(width) for _, runs in _pieces(b, span) if len(runs.first))]
            ids, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(counts)], ["h", "c"])

    counted = over_batches(docs.select("text"), read, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1")
    return _filled(counted)


def _filled(hashes: DataFrame) -> np.ndarray | None:
    bits = bloom.build(hashes, "h", FILTER_BITS)
    return bits if bits.any() else None


def _suffixes(docs: DataFrame, span: int, widths: list[int], filters: list[np.ndarray]) -> DataFrame:
    """(bucket, name1, name2, key, place) of the runs that pass all filters: the first by bucket, later ones, one a round, by speaker."""
    sent = [docs.sparkSession.sparkContext.broadcast(f) for f in filters]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(KEY).to_numpy()
            for row, runs in _pieces(b, span):
                runs.take(bloom.holds(sent[0].value, runs.buckets(widths[0]))) if len(runs.first) else None
                for width, speakers in zip(widths[1:], sent[1:]):
                    if len(runs.first):
                        told = instance(keys[row + runs.text], runs.places())
                        runs.take(bloom.holds(speakers.value, told)).split(width)
                if len(runs.first):
                    x, y = runs.names()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v.view(np.int64)) for v in (runs.buckets(widths[-1]), x, y, keys[row + runs.text], runs.places())],
                        ["bucket", "name1", "name2", KEY, "place"])

    return over_batches(docs.select("text", KEY), read, f"bucket long, name1 long, name2 long, {KEY} long, place long")


def _speakers(classes: DataFrame) -> DataFrame:
    """(h): the one run that speaks for each name, in buckets where a name is alone and another is near."""
    mixed = classes.groupBy(F.col("bucket").alias("h")).agg(F.count("*").alias("names"), F.min("c").alias("least")).filter("names > 1 AND least = 1")
    sent = classes.sparkSession.sparkContext.broadcast(bloom.build(mixed, "h", FILTER_BITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = bloom.holds(sent.value, b.column("bucket").to_numpy())
            told = instance(b.column(KEY).to_numpy()[ok], b.column("place").to_numpy()[ok])
            yield pa.RecordBatch.from_arrays([pa.array(told)], ["h"])

    return over_batches(classes.select("bucket", KEY, "place"), read, "h long")


def repeated_runs(docs: DataFrame, span: int) -> DataFrame:
    """(key, place) of runs of windows all of which occur twice or more, from rows (key, text); together they are all such windows."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], f"{KEY} long, place long")
    width = span - GRAM + 1
    first = _repeated(docs, span)
    if first is None:
        return none
    widths, filters, settled = [width], [first], none
    while True:
        rows = cut(_suffixes(docs, span, widths, filters))
        classes = cut(rows.groupBy("bucket", "name1", "name2").agg(
            F.count("*").alias("c"), F.min(KEY).alias(KEY), F.min_by("place", KEY).alias("place")))
        told = classes.filter("c > 1").select("name1", "name2")
        settled = settled.unionByName(rows.join(told, ["name1", "name2"], "left_semi").select(KEY, "place"))
        if width == 1:
            return settled
        more = _filled(_speakers(classes))
        if more is None:
            return settled
        width = -(-width // SPLIT)
        widths, filters = [*widths, width], [*filters, more]


def without_repeats(documents: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row: ``kept`` are the bytes that no repeated string of ``span`` bytes covers."""
    if not GRAM <= span < GRAM + 256:
        raise ValueError(f"span must be between {GRAM} and {GRAM + 255}")
    docs = keyed(documents.select(F.col(id_col).alias("doc_id"), as_bytes(text_col, "text")))
    marks = cut(repeated_runs(docs, span).groupBy(KEY).agg(F.collect_list("place").alias("places")))
    clear, rest = bloom.parted(docs, [F.xxhash64(KEY)], bloom.build(marks.select(F.xxhash64(KEY).alias("h")), "h", FILTER_BITS))
    kind = dict(documents.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for text, places in zip(b.column("text"), b.column("places")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if places.is_valid:
                    p = places.values.to_numpy()
                    np.add.at(change, p >> 8, 1)
                    np.add.at(change, (p >> 8) + (p & 255) + span, -1)
                gone = np.cumsum(change[:-1]) > 0
                starts = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[:1].any())
                out.append((len(data), int(gone.sum()), starts, data[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.binary()]))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    marked = over_batches(rest.join(marks, KEY, "left").select("doc_id", "text", "places"), strip, schema)
    zero = F.lit(0).cast("long")
    return clear.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept")).unionByName(marked)
