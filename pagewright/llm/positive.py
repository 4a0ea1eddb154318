"""Toxicity: non-negative positive-unlabelled learning.

Positives are confirmed toxic rows; every other row of the sample is taken as unlabelled text, its own label unseen. With the
class prior ``pi`` the risk is ``pi * loss(P, +) + max(0, loss(U, -) - pi * loss(P, -))``: the bracket estimates the
risk of the negatives and may not fall below zero; where a batch drives it below, the step goes the other way.
A sparse linear classifier over the presence of hashed words and word beginnings is trained in numpy, with soft
thresholding so that only telling n-grams keep a weight.

Bounded: at most ``ROWS`` labelled rows, ``BUCKETS`` weights (1 MB) in the broadcast.

Results: a null or wordless text scores the bias alone; repeated rows score alike; without a positive example every score
is that of the bias, below 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from .words import SpanHash, letters_and_digits, lower_table, spans, text_blocks

ROWS = 8000
BUCKETS = 1 << 18
#: Bytes of the beginnings of words that are features, besides the whole words; inflected forms of a word share one.
STEMS = (4,)
#: Rows of the sample a feature must occur in: this share of them, and three at least.
SEEN, LEAST_SEEN = 0.0005, 3
#: Rows of a batch, and steps of the descent: forty rounds over a full sample, more over a smaller one.
BATCH, STEPS = 1000, 320
RATE = 0.1
THIN = 2e-4


class Features:
    """Buckets of the words, and of the beginnings of words, of a block."""

    def __init__(self):
        self.lower, self.table, self.hasher = lower_table(), letters_and_digits(), SpanHash(6)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.lower[data]
        s, e, text = spans(low, bounds, self.table)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = self.hasher.sums(low)
        found, owner = [self.hasher.of(sums, s, e)], [text]
        for n in STEMS:
            long = e - s > n
            found.append(self.hasher.of(sums, s[long], s[long] + n) ^ np.uint64(0xC0FFEE))
            owner.append(text[long])
        return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def _bags(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, row starts, rows per bucket) of the features present in each text; 32-bit, for this is the driver's largest table."""
    features, cols, sizes, seen = Features(), [np.zeros(0, np.int32)], [], np.zeros(BUCKETS, np.int64)
    for _, data, bounds in text_blocks(texts):
        bucket, owner = features.of(data, bounds)
        u = np.unique(owner * BUCKETS + bucket)
        cols.append((u % BUCKETS).astype(np.int32))
        seen += np.bincount(cols[-1], minlength=BUCKETS)
        sizes.append(np.bincount(u // BUCKETS, minlength=len(bounds) - 1))
    return np.concatenate(cols), np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))]), seen


def risk_slopes(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Slopes of the corrected risk in the scores ``z`` of a batch, with the logistic loss."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    minus = np.logaddexp(0, z)
    negatives = minus[~positive].sum() / n_u - prior * minus[positive].sum() / n_p
    part = np.where(positive, -prior * p / n_p, p / n_u)
    if negatives < 0:
        return -part
    return part + np.where(positive, -prior * (1 - p) / n_p, 0.0)


def train(texts: pa.ChunkedArray, labels: np.ndarray, prior: float | None = None, steps: int = STEPS, seed: int = 11) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias). Without ``prior``, the share of positives among the labelled rows stands in for it."""
    positive = labels > 0
    weight = np.zeros(BUCKETS, np.float32)
    if not positive.any():
        return weight, -4.0
    prior = float(positive.mean()) if prior is None else prior
    cols, starts, seen = _bags(texts)
    often = seen >= max(LEAST_SEEN, int(np.ceil(SEEN * len(labels))))
    names = np.full(BUCKETS, -1, np.int32)
    names[often] = np.arange(often.sum(), dtype=np.int32)
    keep = often[cols]
    owner = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(starts))[keep]
    cols = names[cols[keep]]
    starts = np.searchsorted(owner, np.arange(len(labels) + 1))
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(int(often.sum())), np.log(prior / (1 - prior)) if prior < 1 else 4.0
    speed, bias_speed = np.full(len(w), 1e-8), 1e-8
    everyone = np.arange(len(labels))
    parts = max(1, len(labels) // BATCH)
    for _ in range(-(-steps // parts)):
        order = rng.permutation(everyone)
        for batch in np.array_split(order, parts):
            # unlabelled text is the whole sample; confirmed rows also stand as positives
            span = np.diff(starts)[batch]
            rows = np.repeat(np.arange(len(batch)), span)
            at = np.repeat(starts[batch] - np.cumsum(span) + span, span) + np.arange(span.sum())
            c = cols[at]
            z = np.bincount(rows, weights=w[c], minlength=len(batch)) + bias
            both = np.concatenate([positive[batch], np.zeros(len(batch), bool)])
            slope = risk_slopes(np.concatenate([z, z])[np.concatenate([positive[batch], np.ones(len(batch), bool)])],
                                both[np.concatenate([positive[batch], np.ones(len(batch), bool)])], prior)
            g = np.zeros(len(batch))
            g[positive[batch]] += slope[:positive[batch].sum()]
            g += slope[positive[batch].sum():]
            grad = np.bincount(c, weights=g[rows], minlength=len(w))
            speed += grad ** 2
            step = RATE / np.sqrt(speed)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * THIN, 0)
            bias_speed += g.sum() ** 2
            bias -= RATE / np.sqrt(bias_speed) * g.sum()
    weight[often] = w
    z = np.bincount(owner, weights=w[cols], minlength=len(labels))
    return weight, -zero_one_cut(z, positive, prior)


def zero_one_cut(z: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The cut of least corrected zero-one risk, in the middle of the cuts that share it: thresholding shrinks scores, this sets 0.5 right."""
    order = np.argsort(z, kind="stable")
    missed = np.concatenate([[0], np.cumsum(positive[order])]) / positive.sum()
    flagged = 1 - np.arange(len(z) + 1) / len(z)
    risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
    edge = np.concatenate([[z[order[0]] - 2], z[order], [z[order[-1]] + 2]])
    free = edge[1:] > edge[:-1]  # no cut between equal scores
    risk = np.where(free, risk, np.inf)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float((edge[best[0]] + edge[best[-1] + 1]) / 2)


def scorer(weight: np.ndarray, bias: float):
    """For :func:`labelled.scored`: a block of texts to the probability of being toxic."""
    features = Features()

    def score(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bucket, owner = features.of(data, bounds)
        told = weight[bucket] != 0
        u = np.unique(owner[told] * BUCKETS + bucket[told])
        total = np.bincount(u // BUCKETS, weights=weight[u % BUCKETS], minlength=len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))

    return score


def model(documents: DataFrame, labels: DataFrame, rows: int = ROWS, prior: float | None = None):
    """The trained scorer factory; the weights travel as a broadcast of fixed size."""
    texts, y = labelled.sample(documents, labels, "toxic", rows)
    sent = documents.sparkSession.sparkContext.broadcast(train(texts, y, prior))
    return lambda: scorer(*sent.value)


def toxicity_scores(documents: DataFrame, labels: DataFrame, rows: int = ROWS, prior: float | None = None) -> DataFrame:
    """(doc_id, score) per row of ``documents``: how likely ``labels.toxic`` is 1."""
    return labelled.scored(documents, model(documents, labels, rows, prior))
