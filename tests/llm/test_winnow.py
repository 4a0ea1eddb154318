"""Decontamination against every window of every text."""

import random
import re

from pyspark.sql import functions as F

from pagewright.llm import winnow


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(docs, items, span=10):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            m = min(len(v), span)
            windows = {tuple(v[j:j + m]) for j in range(len(v) - m + 1)} if v else set()
            for j in range(len(w) - m + 1):
                if m and tuple(w[j:j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_equals_all_windows(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice("a b c d é Zz 7".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 12, 10, 9, 3, 40, 10))] + [(7, ""), (8, None), (9, "...")]
    items.append((10, items[0][1]))
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 25)))]
        for _ in range(rnd.randint(0, 3)):
            v = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(v) - 1))
            parts += [", ".join(v[a:a + rnd.randint(1, 40)]).upper(), word()]
        docs.append((i, "-".join(parts)))
    docs += [(100, None), (101, ""), (102, "!!!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fp", "at", "context", "start", "item", "n_words")})
    ref = spark.createDataFrame(items, "item_id long, text string").withColumn("short", F.lit(0))
    got = winnow.contamination(df, ref).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == brute(docs, items)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(None, run), (1, run), (1, "x"), (2, run * 50)], "doc_id long, text string")
    ref = spark.createDataFrame([(1, run), (1, run)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in winnow.contamination(docs, ref).collect()), key=str)
    assert got[:3] == [(0, 12, 12, ("1",)), (1, 1, 12, ("1",)), (1, 12, 12, ("1",))]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert winnow.contamination(none, ref).count() == 0
    clean = winnow.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r["n_hit"], r["items"], r["spans"]) for r in clean] == [(0, [], [])] * 4
