"""Measures against plain Python, verdicts against the formula."""

import random
import re

from pyspark.sql import functions as F

from pagewright.llm import hosts


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    marked = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_measures_and_verdicts(spark):
    rnd = random.Random(4)
    texts = [None, "", "\n\n", "a", "a a a", "a a a a", "x y z x y z", "a#b|<>", "l\nl\n \nl", "日本 語", "\x0b\x0cq\r\n"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 120))) + rnd.choice(["", "\nq\nq", " $$"]) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(20_000))]
    rows = [(i, t, rnd.choice(["h1", "h2", "h3", None])) for i, t in enumerate(texts)] + [(500, "bad", "h9")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(0) for c in ("n_words", "_counts", "kept", "host_id", "rate")})
    got = hosts.quality_verdicts(df).collect()
    assert len(got) == len(rows)
    by = {i: plain(t) for i, t, _ in rows}
    failed = {i: m[0] < 50 or 100 * m[4] > 50 * m[0] for i, m in by.items()}
    tally = {}
    for i, _, h in rows:
        n, f = tally.get(h, (0, 0))
        tally[h] = (n + 1, f + failed[i])
    mean = sum(f for _, f in tally.values()) / len(rows)
    rates = [f / n for n, f in tally.values()]
    spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
    between = spread - mean * (1 - mean) * sum(1 / n for n, _ in tally.values()) / len(tally)
    s = min(max(mean * (1 - mean) / between - 1, 2.0), 10_000.0) if between > 0 else 10_000.0
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == by[r["doc_id"]], r
        n, f = tally[r["host"]]
        assert r["base_failed"] == failed[r["doc_id"]] and abs(r["host_rate"] - (f + mean * s) / (n + s)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= 0.5)


def test_empty_and_even_hosts(spark):
    assert hosts.quality_verdicts(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    same = spark.createDataFrame([(i, "short", f"h{i % 3}") for i in range(9)], "doc_id long, text string, source string")
    assert {r["host_rate"] for r in hosts.quality_verdicts(same).collect()} == {1.0}
