"""Token counts by a map-side two-tier lookup, and token ids by the same chunks.

A byte-level tokenizer never merges across the border between a word and the space before the next one, so a text is
cut there into chunks (a word with at most one space before it, or a run of other white space) whose counts add
up. Tier one is a broadcast table of the lengths of frequent chunks, at most ``FREQUENT`` of them; tier two is a bounded cache in each
task, filled by the tokenizer itself on a miss. Chunks never leave their task: there is no shuffle.

The frequent chunks are counted over all documents: each task keeps a sketch of ``SKETCH`` counters (what does not fit lowers all others alike, so any
chunk with more than a ``SKETCH``-th part of a task's chunks is in it), and Spark adds the sketches up. Chunks of more than ``LONGEST`` bytes are left to
tier two. The table only decides which tier answers, never a count: every count is the tokenizer's own.
Texts where the chunk rule might not hold (white space outside ASCII, control separators, strings like a special token)
are given to the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_bytes, over_batches
from .words import SpanHash, lower_table, space_separated, spans, text_blocks

FREQUENT = 1 << 15
SKETCH = 1 << 13
LONGEST = 48
#: Entries of a task's cache; at the bound it starts anew.
CACHED = 1 << 19


def tokenizer_at(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold white space outside ASCII, a control separator or the start of a special token."""
    n = len(data)
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    at = np.flatnonzero((data == 0x3C) | ((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    a, b, c = data[at], pad[at + 1], pad[at + 2]
    hit = (
        ((a == 0x3C) & (b == 0x7C)) | (a <= 0x1F) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )
    out = np.zeros(len(bounds) - 1, bool)
    if n and hit.any():
        out[np.searchsorted(bounds, at[hit], side="right") - 1] = True
    return out


def byte_chunks(data: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the chunks of a byte-level tokenizer: word with one space before it; other white space."""
    s, e, text = spans(data, bounds, words)
    first = np.ones(len(s), bool)
    first[1:] = text[1:] != text[:-1]
    gap = np.where(first, bounds[text] if len(s) else s, np.concatenate([[0], e[:-1]]) if len(s) else s)
    joined = (s > gap) & (data[np.maximum(s - 1, 0)] == 32) if len(s) else first
    head = s - joined
    run = head - gap  # white space before the chunk, without the space that goes with the word
    # a run that ends in something other than a space leaves its last character on its own
    alone = (run > 0) & ~joined
    lead = run - alone
    last = np.ones(len(s), bool)
    last[:-1] = first[1:]
    tail_text = np.arange(len(bounds) - 1)
    tail_from = bounds[:-1].copy()
    tail_from[text[last]] = e[last]
    tail = tail_from < bounds[1:]
    starts = np.concatenate([head, gap[lead > 0], head[alone] - 1, tail_from[tail]])
    ends = np.concatenate([e, (gap + lead)[lead > 0], head[alone], bounds[1:][tail]])
    owner = np.concatenate([text, text[lead > 0], text[alone], tail_text[tail]])
    return starts, ends, owner


class Sketch:
    """The most frequent short chunks of a stream of blocks, in at most twice ``SKETCH`` counters."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.size = np.zeros((0, LONGEST), np.uint8), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        short = end - start <= LONGEST
        start, size = start[short], (end - start)[short]
        at = np.minimum(start[:, None] + np.arange(LONGEST), len(data) - 1)
        both = np.concatenate([self.hashes, hashes[short]])
        self.hashes, first, back = np.unique(both, return_index=True, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts[short]])).astype(np.int64)
        self.raw, self.size = np.concatenate([self.raw, data[at]])[first], np.concatenate([self.size, size])[first]
        if len(both) > 2 * SKETCH:
            floor = np.sort(self.counts)[::-1][SKETCH] if len(self.counts) > SKETCH else 0
            keep = self.counts > floor
            self.hashes, self.counts, self.raw, self.size = self.hashes[keep], self.counts[keep] - floor, self.raw[keep], self.size[keep]

    def rows(self) -> pa.RecordBatch:
        chunks = [r[:n].tobytes() for r, n in zip(self.raw, self.size)]
        return pa.RecordBatch.from_arrays([pa.array(self.hashes.view(np.int64)), pa.array(self.counts), pa.array(chunks, pa.binary())], ["h", "n", "chunk"])


def frequent_lengths(documents: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and token counts of the most frequent chunks of all documents: tier one, about 500 KB."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher, sketch = space_separated(), SpanHash(3), Sketch()
        for b in batches:
            for _, data, bounds in text_blocks(b.column("text")):
                s, e, _ = byte_chunks(data, bounds, words)
                if len(s):
                    u, at, n = np.unique(hasher.of(hasher.sums(data), s, e), return_index=True, return_counts=True)
                    sketch.add(u, n, data, s[at], e[at])
        yield sketch.rows()

    counted = over_batches(documents.select("text"), count, "h long, n long, chunk binary").groupBy("h").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk"))
    best = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    got = tokenizer_at(path).encode_batch_fast([c.as_py().decode("utf-8", "replace") for c in best.column("chunk")], add_special_tokens=False)
    hashes = best.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([len(x) for x in got], np.int64)[order]


def token_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row; null texts count as empty, repeated rows stay, extra columns are ignored.

    ``path`` names a byte-level ``tokenizers`` file that is there on every executor.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), as_bytes(text_col, "text"))
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select("text"), path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher, tok = space_separated(), SpanHash(3), tokenizer_at(path)
        known, lengths = sent.value
        cache: dict[int, int] = {}
        for b in batches:
            for row, data, bounds in text_blocks(b.column("text")):
                n = len(bounds) - 1
                odd = odd_texts(data, bounds)
                s, e, owner = byte_chunks(data, bounds, words)
                u, at, back = np.unique(hasher.of(hasher.sums(data), s, e), return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
                size = np.full(len(u), -1, np.int64)
                if len(known):
                    size = np.where(known[place] == u, lengths[place], -1)
                miss = np.flatnonzero(size < 0)
                got = [cache.get(h, -1) for h in u[miss].tolist()]
                size[miss] = got
                new = miss[size[miss] < 0]
                if len(new):
                    raw = data.tobytes()
                    lo, hi = s[at[new]].tolist(), e[at[new]].tolist()
                    size[new] = [len(x) for x in tok.encode_batch_fast([raw[x:y].decode("utf-8", "replace") for x, y in zip(lo, hi)], add_special_tokens=False)]
                    if len(cache) + len(new) > CACHED:
                        cache.clear()
                    cache.update(zip(u[new].tolist(), size[new].tolist()))
                total = np.bincount(owner, weights=size[back], minlength=n).astype(np.int64) if len(u) else np.zeros(n, np.int64)
                for i in np.flatnonzero(odd):
                    total[i] = len(tok.encode(data[bounds[i]:bounds[i + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, n), pa.array(np.diff(bounds)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return over_batches(docs, count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")


class WordIds:
    """Token ids of words, each encoded once per cache; for tokenizers that drop white space and lower-case.

    Words end at white space and before a comma, stop or the like that follows an ASCII letter or digit: the tokenizer splits
    there as well. A-Z is lowered first, unless a special token's opening is about, for those are told apart by case.
    """

    def __init__(self, path: str):
        self.tok, self.table, self.hasher, self.lower = tokenizer_at(path), space_separated(), SpanHash(4), lower_table()
        self.mark, self.plain = np.zeros(256, bool), np.zeros(256, bool)
        self.mark[list(b".,;:!?)")] = True
        self.plain[0x30:0x3A] = self.plain[0x41:0x5B] = self.plain[0x61:0x7B] = True
        self._fresh()

    def _words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = data if b"<|" in data.tobytes() else self.lower[data]
        s, e, text = spans(low, bounds, self.table)
        cut = np.flatnonzero(self.mark[low[1:]] & self.plain[low[:-1]]) + 1
        if len(s):
            word = np.searchsorted(s, cut, side="right") - 1
            inner = (word >= 0) & (cut > s[word]) & (cut < e[word])
            cut, word = cut[inner], word[inner]
            where = np.searchsorted(s, cut)
            s, e, text = np.insert(s, where, cut), np.sort(np.concatenate([e, cut])), np.insert(text, where, text[word])
        return low, s, e, text

    def _fresh(self) -> None:
        self.where: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)  # place 0 holds the id that ends a document
        self.used = 1
        self.known = 1
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.size[0] = 1

    def _add(self, found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        need, more = self.used + int(sizes.sum()), self.known + len(found)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), np.int32)])
        while more > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used:need] = list(chain.from_iterable(found))
        self.size[self.known:more] = sizes
        self.start[self.known:more] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = need, more

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by id 0; ids per text)."""
        n = len(bounds) - 1
        data, s, e, text = self._words(data, bounds)
        u, at, back = np.unique(self.hasher.of(self.hasher.sums(data), s, e), return_index=True, return_inverse=True)
        if len(self.where) + len(u) > CACHED:
            self._fresh()
        keys = u.tolist()
        slot = np.array([self.where.get(h, -1) for h in keys], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = data.tobytes()
            lo, hi = s[at[new]].tolist(), e[at[new]].tolist()
            base = self.known
            self._add([x.ids for x in self.tok.encode_batch_fast([raw[x:y].decode("utf-8", "replace") for x, y in zip(lo, hi)], add_special_tokens=False)])
            slot[new] = base + np.arange(len(new))
            self.where.update((keys[i], base + k) for k, i in enumerate(new.tolist()))
        words = np.bincount(text, minlength=n)
        each = np.insert(slot[back] if len(u) else np.zeros(0, np.int64), np.cumsum(words), 0)
        starts, sizes = self.start[each], self.size[each]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.pool[np.repeat(starts - begin[:-1], sizes) + np.arange(begin[-1])]
        ends = np.cumsum(words + 1)
        return flat, np.diff(np.concatenate([[0], begin[ends]]))
