"""Removed bytes against every string of the span, counted in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.llm import rows, suffixes


def brute(texts, span):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = [True] * span
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def check(spark, texts, span, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df, span).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, span)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == want, i


def words(rnd, n, of=400):
    return " ".join(f"w{rnd.randrange(of)}" for _ in range(n))


@pytest.mark.parametrize("seed,span", [(1, 200), (2, 64), (3, 32)])
def test_passages_copies_and_edits(spark, seed, span):
    rnd = random.Random(seed)
    shared = [words(rnd, 30 + 20 * i) for i in range(8)]
    texts = [None, "", "short", "é" * 150]
    for i in range(60):
        parts = [words(rnd, rnd.randrange(60)) for _ in range(3)]
        if rnd.random() < 0.7:
            at = rnd.choice(shared)
            cut = rnd.randrange(len(at) // 2)
            parts.insert(rnd.randrange(3), at[cut:cut + rnd.randrange(30, len(at))])
        texts.append(" ".join(parts))
    for _ in range(20):  # near copies: an edit every so often
        t = list(rnd.choice(texts[4:40]))
        for _ in range(rnd.randrange(4)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice("xyzé")
        texts.append("".join(t))
    texts += [texts[10]] * 5
    check(spark, texts, span)


def test_exact_length_of_a_repeat(spark):
    rnd = random.Random(5)
    texts = []
    for n in (199, 200, 201, 368, 369, 600):  # strings of their own, so that one corpus holds all cases
        s, own = ("".join(rnd.choice("abcdefgh") for _ in range(n)) for _ in range(2))
        texts += [f"1{s}2", f"3{s}4", f"5{s}", f"1{own}2 {words(rnd, 80, 10**6)} 3{own}4"]
    check(spark, texts, 200)


def test_low_variety_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rnd = random.Random(6)
    s = words(rnd, 900)
    check(spark, ["a" * 900, "ab" * 300 + "c", "a" * 199, s, words(rnd, 300) + s[1000:3500] + words(rnd, 50), "a" * 250 + "b" * 250], 200)
    check(spark, ["a" * 500], 200)


def test_repeated_ids_empty_table_and_other_columns(spark):
    t = words(random.Random(7), 100)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None), (2, "x")], "doc_id long, text string")
    odd = df.withColumns({c: F.lit(1) for c in ("_row", "_hash0", "bucket", "name1", "place", "places", "key", "kept", "_metadata")})
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffixes.without_repeats(odd).collect())
    n = len(t.encode())
    assert got == [("1", n), ("1", n), ("2", 0), ("None", 0), ("None", n)]
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_row_keys(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    keys = rows.keyed(df)
    assert keys.select(rows.KEY).distinct().count() == 1000 and keys.filter("_row < 0").count() == 0
    assert {tuple(r) for r in keys.collect()} == {tuple(r) for r in keys.repartition(3).collect()}
    assert rows.keyed(spark.range(5).repartition(2)).select(rows.KEY).distinct().count() == 5
    assert rows.keyed(spark.createDataFrame([], "a long")).count() == 0
    with pytest.raises(ValueError):
        rows.keyed(df.withColumn("_row", F.lit(1)))
