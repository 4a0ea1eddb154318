"""Classifiers: held-out accuracy, the risk estimator, and odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import labelled, positive, subword

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("scores, label, at, least", [(subword.quality_scores, "quality", 0.3, 0.97), (positive.toxicity_scores, "toxic", 0.5, 0.9)])
def test_held_out_rows_are_judged_right(tables, scores, label, at, least):
    documents, labels = tables
    rows = scores(documents, labels).withColumn("held", labelled.held_out()).join(labels, "doc_id").filter("held").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([(r["score"] >= at) == bool(r[label]) for r in rows]) >= least


@pytest.mark.parametrize("scores, label, at, right, caught", [(subword.quality_scores, "quality", 0.3, 0.97, 0.97), (positive.toxicity_scores, "toxic", 0.5, 0.97, 0.93)])
def test_held_out_precision_and_recall(spark, scores, label, at, right, caught):
    """Over the rare class of a larger table, where a scorer that calls all rows alike is nothing."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = scores(documents, labels).filter(labelled.held_out()).join(labels, "doc_id").toPandas()
    rare = int(label == "toxic")  # poor quality, or toxic
    said, true = (held["score"] >= at).astype(int) == rare, held[label] == rare
    assert true.sum() > 80 and (said & true).sum() >= right * said.sum() and (said & true).sum() >= caught * true.sum()


def test_toxicity_scores_are_those_of_the_weights():
    """The scorer against sums over words and their beginnings taken one by one."""
    texts = ["Bad words, bad WORDS here", "", "nice day", "bä d wordy 123abc", None]
    weight = np.random.default_rng(3).normal(size=positive.BUCKETS).astype(np.float32) * (np.random.default_rng(4).random(positive.BUCKETS) < 0.5)
    hasher, column = positive.Features().hasher, pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    score = positive.scorer(weight, -0.7)
    for _, data, bounds in positive.text_blocks(column):
        got = score(data, bounds)
    for t, z in zip(texts, got):
        buckets = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()):
            for part, salt in [(w, 0)] + [(w[:n], 0xC0FFEE) for n in positive.STEMS if len(w) > n]:
                raw = np.frombuffer(part, np.uint8)
                h = hasher.of(hasher.sums(raw), np.array([0]), np.array([len(raw)])) ^ np.uint64(salt)
                buckets.add(int(h[0] % np.uint64(positive.BUCKETS)))
        assert z == pytest.approx(1 / (1 + np.exp(-(sum(float(weight[b]) for b in buckets) - 0.7))), abs=1e-6)


def test_the_bound_of_the_sample_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(i, "x") for i in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, quality int")
    texts, y = labelled.sample(docs, labels, "quality", 50)
    assert len(texts) == len(y) == 50
    texts, y = labelled.sample(docs, labels, "quality", 1000)
    assert len(texts) == len({i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5})


def test_labels_of_the_held_out_fold_are_never_seen(spark, tables):
    documents, labels = tables
    twisted = labels.withColumn("quality", F.when(labelled.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = labelled.sample(documents, labels, "quality", 50)
    b = labelled.sample(documents, twisted, "quality", 50)
    assert a[0].to_pylist() == b[0].to_pylist() and a[1].tolist() == b[1].tolist() and len(a[1]) == 50


@pytest.mark.parametrize("scores", [subword.quality_scores, positive.toxicity_scores])
def test_odd_rows_and_tables(spark, scores):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad!! stuff") for i in range(40)] + [(90, None), (91, ""), (92, "x" * 300_000), (None, "good"), (3, "good text here")],
                                 "doc_id long, text string").withColumns({"score": F.lit("s"), "_y": F.lit(1), "quality": F.lit(0)})
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(1, 0, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = scores(docs, labels).collect()
    assert len(got) == 45 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert scores(docs, labels.limit(0)).count() == 45
    assert scores(docs.limit(0), labels).count() == 0


def test_filtering_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "aa", 5), (2, None, 6), (3, "b", 7)], "doc_id long, text string, score int")
    make = lambda: lambda data, bounds: np.diff(bounds).astype(float)
    assert [tuple(r) for r in labelled.kept(docs, make, lambda s: s != 1).orderBy("doc_id").collect()] == [(1, "aa", 5), (2, None, 6)]


def test_slopes_are_those_of_the_corrected_risk():
    rng = np.random.default_rng(2)
    pos = rng.random(40) < 0.4

    def risk(z, flipped=False):
        loss = lambda v: np.logaddexp(0, -v)
        negatives = loss(-z[~pos]).mean() - 0.3 * loss(-z[pos]).mean()
        return negatives, 0.3 * loss(z[pos]).mean() + negatives

    for shift in (0.0, 6.0):
        z = rng.normal(size=40) + np.where(pos, shift, -shift)
        negatives, _ = risk(z)
        slope = positive.risk_slopes(z, pos, 0.3)
        for i in range(5):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            which = 0 if negatives < 0 else 1
            numeric = (risk(up)[which] - risk(down)[which]) / 2e-5 * (-1 if negatives < 0 else 1)
            assert slope[i] == pytest.approx(numeric, abs=1e-6)


def test_repeats_are_seen_whatever_the_word():
    texts = pa.chunked_array([pa.array([f"w{i} " * 30 if i % 2 else " ".join(f"w{i}{j}" for j in range(30)) for i in range(60)])])
    weight, bias = subword.train(texts, np.array([1.0 - i % 2 for i in range(60)]))
    score = subword.scorer(weight, bias)
    raw = np.frombuffer(b"zzz zzz zzz zzz zzz zzz", np.uint8)
    other = np.frombuffer(b"qa qb qc qd qe qf qg qh", np.uint8)
    assert score(raw, np.array([0, len(raw)]))[0] < 0.5 < score(other, np.array([0, len(other)]))[0]
