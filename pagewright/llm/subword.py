"""Quality classifier: supervised subword embeddings.

Every word n-gram and every character n-gram of a word is hashed to a learned vector; a document is the mean of its vectors;
a softmax over two outputs gives the score. Trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``ROWS``). A word that repeats the word before it is written as a back-reference in its word
bigram, so that "the same again" is one n-gram whichever word it is.

Because the mean and the output layer are linear, scoring needs one number per bucket: the broadcast is
``BUCKETS`` floats (1 MB) whatever the corpus.

Results: a null or wordless text gets the score of the output bias alone; rows that repeat are scored alike; without any
label the score is 0.5; with labels of one kind only, the score tends to that kind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from .words import SpanHash, mix, space_separated, spans, text_blocks

#: Labelled rows that are learned from, at most.
ROWS = 2000
BUCKETS = 1 << 18
WIDTH = 16
#: Steps of the descent, a document each: four rounds over a full sample, more over a smaller one.
STEPS = 8000
RATE = 40.0
CHARS = (3, 4)


class Subwords:
    """Buckets of the word and character n-grams of a block."""

    def __init__(self):
        self.table, self.hasher = space_separated(), SpanHash(5)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, text numbers), unordered, with repeats."""
        s, e, text = spans(data, bounds, self.table)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = self.hasher.sums(data)
        words = self.hasher.of(sums, s, e)
        found, owner = [words], [text]
        same = words[1:] == words[:-1]
        near = text[1:] == text[:-1]
        pairs = np.where(same, np.uint64(2), mix(words[:-1]) + words[1:])
        found.append(mix(pairs[near] + np.uint64(1)))
        owner.append(text[1:][near])
        length = e - s
        for n in CHARS:
            count = np.maximum(length - n + 1, 0)
            first = np.repeat(s, count)
            step = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            at = first + step
            ends = (step == 0) * np.uint64(11) + (step + n == np.repeat(length, count)) * np.uint64(13)
            found.append(self.hasher.of(sums, at, at + n) + ends.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            owner.append(np.repeat(text, count))
        return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def train(texts: pa.ChunkedArray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias): the score is the logistic of the mean weight plus the bias."""
    grams, bags = Subwords(), []
    for _, data, bounds in text_blocks(texts):
        bucket, owner = grams.of(data, bounds)
        u, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
        cuts = np.searchsorted(u, np.arange(len(bounds)) * BUCKETS)
        for i in range(len(bounds) - 1):
            part = n[cuts[i]:cuts[i + 1]]
            bags.append(((u[cuts[i]:cuts[i + 1]] - i * BUCKETS).astype(np.int32), (part / max(1, part.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    epochs = -(-steps // max(1, len(bags)))
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs if bags else 0):
        for i in rng.permutation(len(bags)):
            lr = 1 - done / steps
            done += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ out
            out -= np.float32(0.5 * lr) * np.outer(p, hidden)
            bias -= np.float32(0.05 * lr) * p
            vectors[ids] -= np.float32(rate * lr) * share[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scorer(weight: np.ndarray, bias: float):
    """For :func:`labelled.scored`: a block of texts to the probability of label 1."""
    grams = Subwords()

    def score(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bucket, owner = grams.of(data, bounds)
        n = len(bounds) - 1
        total = np.bincount(owner, weights=weight[bucket], minlength=n)
        size = np.bincount(owner, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1) + bias, -30, 30)))

    return score


def model(documents: DataFrame, labels: DataFrame, rows: int = ROWS):
    """The trained scorer factory; the weights travel as a broadcast of fixed size."""
    texts, y = labelled.sample(documents, labels, "quality", rows)
    sent = documents.sparkSession.sparkContext.broadcast(train(texts, np.clip(y, 0, 1)))
    return lambda: scorer(*sent.value)


def quality_scores(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, score) per row of ``documents``: how likely ``labels.quality`` is 1."""
    return labelled.scored(documents, model(documents, labels, rows))
