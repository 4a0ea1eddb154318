import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import retrieval as R
from pagewright.operators.prompts import with_trigger


def _entries(spark, n=40):
    rows = [(i, ["hero", f"w{i}"] + (["rooftop"] if i % 3 == 0 else []), i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "entry_idx long, words array<string>, has_ref boolean")


def _hits(df, pid):
    return [r["entry_idx"] for r in df.filter(F.col("prompt_id") == pid).orderBy("rank").collect()]


def test_fallback_and_reference_filter(spark):
    p = spark.createDataFrame([(1, "zzzz qqqq nothing"), (2, ""), (3, "hero hero ROOFTOP!")], "prompt_id long, text string")
    on = R.retrieve_topk(_entries(spark), p)
    off = R.retrieve_topk(_entries(spark), p, require_ref=False)
    assert _hits(on, 1) == _hits(on, 2) == [0, 2, 4, 6]
    assert _hits(off, 1) == [0, 1, 2, 3]
    assert _hits(on, 3) == [0, 6, 12, 18]
    assert _hits(off, 3) == [0, 3, 6, 9]


def test_index_equals_walk(spark):
    p = spark.createDataFrame([(1, "hero w3 w4"), (2, "rooftop w9"), (3, "none")], "prompt_id long, text string")
    e = _entries(spark)
    assert R.rows_differ(R.keyword_score(R.retrieve_join(e, p)), R.walk_score(e, p)).count() == 0


def test_the_walk_sees_what_the_index_misses(spark, monkeypatch):
    p = spark.createDataFrame([(1, "hero w3 w4"), (2, "rooftop w9"), (3, "none")], "prompt_id long, text string")
    e = _entries(spark)
    whole, real = R.retrieve_join(e, p), R.retrieve_join
    monkeypatch.setattr(R, "retrieve_join", lambda *a, **k: real(*a, **k).filter("entry_idx <> 9"))
    monkeypatch.setattr(R, "WALK_ENTRIES", 7)
    monkeypatch.setattr(R, "WALK_PROMPTS", 2)
    assert R.rows_differ(R.keyword_score(whole), R.walk_score(e, p)).count() == 0
    missed = R.rows_differ(R.keyword_score(R.retrieve_join(e, p)), R.walk_score(e, p)).collect()
    assert {(r["prompt_id"], r["entry_idx"], r["score"], r["side"]) for r in missed} == {(1, 9, 1, "right"), (2, 9, 2, "right")}


def test_seeded_draws(spark):
    p = spark.createDataFrame([(1, "hero rooftop")], "prompt_id long, text string")
    e = _entries(spark, 100)
    draws = {s: frozenset(r["entry_idx"] for r in R.seeded_draw(e, p, s).collect()) for s in range(6)}
    again = frozenset(r["entry_idx"] for r in R.seeded_draw(e, p, 3).collect())
    strong = set(_hits(R.retrieve_topk(e, p, k=32), 1))
    assert len(set(draws.values())) >= 4 and again == draws[3]
    assert all(len(d) == 4 and d <= strong for d in draws.values())


def test_thinning_matches_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    e = np.vstack([base[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.6) for i in range(90)])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    ranking = spark.createDataFrame([(1, i, i + 1) for i in range(90)], "prompt_id long, entry_idx long, rank int")
    vectors = spark.createDataFrame([(i, e[i].tolist()) for i in range(90)], "entry_idx long, e array<double>")
    for k in (4, 30, 200):
        kept = []
        for i in range(90):
            if len(kept) < k and all(e[i] @ e[j] <= 0.97 for j in kept):
                kept.append(i)
        got = [r["entry_idx"] for r in R.near_dup_thin(ranking, vectors, k=k, pool=8).orderBy("place").collect()]
        assert got == kept
    pairs = R.near_dup_pairs(ranking, vectors, k=200, pool=8).collect()
    assert {r["entry_idx"] for r in pairs} == set(range(90)) - set(kept)
    assert all(r["kept_idx"] == next(j for j in kept if e[r["entry_idx"]] @ e[j] > 0.97) for r in pairs)


def test_trigger_is_not_doubled(spark):
    df = spark.createDataFrame([("a Knight rides", "knight"), ("a horse", "knight"), ("x", None)], "p string, t string")
    got = [r[0] for r in df.select(with_trigger(F.col("p"), F.col("t"))).collect()]
    assert got == ["a Knight rides", "a horse, knight", "x"]


def test_the_kept_index_equals_a_walk(spark, tmp_path):
    """Random words of very unequal frequency, ties at the last place, prompts with few and with no matches."""
    from pagewright.operators import index as I

    rng = np.random.default_rng(5)
    pick = lambda n: sorted({f"w{int(x)}" for x in rng.zipf(1.3, n) if x < 400})
    entries = [(i, pick(rng.integers(0, 40))) for i in range(500)] + [(900 + i, ["w1", "w2", "w3"]) for i in range(30)]
    asked = {p: pick(rng.integers(1, 30)) for p in range(25)} | {50: ["w399x"], 51: ["w1"], 52: ["w1", "w2", "w3", "nowhere"]}
    index = I.build(spark.createDataFrame(entries, "entry_idx long, words array<string>"), str(tmp_path / "index"))
    words = spark.createDataFrame([(p, w) for p, ws in asked.items() for w in ws], "prompt_id long, word string")
    for k in (1, 4, 700):
        got = {}
        for r in I.top_scores(I.opened(spark, str(tmp_path / "index")), words, k).collect():
            got.setdefault(r["prompt_id"], {})[r["rank"]] = (r["entry_idx"], r["score"])
        for p, ws in asked.items():
            scored = sorted(((-len(set(ws) & set(e)), i) for i, e in entries if set(ws) & set(e)))[:k]
            assert got.get(p, {}) == {n + 1: (i, -s) for n, (s, i) in enumerate(scored)}, (k, p)


def test_rows_that_differ_are_counted_once_per_side(spark):
    from pagewright.operators.retrieval import rows_differ

    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "n int, s string")
    right = spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (4, "d")], "n int, s string")
    df = rows_differ(left, right)
    assert sorted(map(tuple, df.collect())) == [(1, "a", "left"), (3, "c", "left"), (4, "d", "right"), (4, "d", "right")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_pairs_are_counted_where_their_entry_lies(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIRS_A_TASK", 10)
    p = spark.range(3).select(F.col("id").alias("prompt_id"), F.concat(F.lit("hero w"), "id").alias("text"))
    scores = R.keyword_score(R.retrieve_join(_entries(spark), p))
    # 40 entries times 3 prompts, ten pairs a task
    assert scores.rdd.getNumPartitions() == 12
    got = {(r["prompt_id"], r["entry_idx"]): r["score"] for r in scores.collect()}
    assert got == {(i, j): 1 + (i == j) for i in range(3) for j in range(40)}


def test_a_walk_looks_at_the_start_of_a_long_ranking(spark, monkeypatch):
    held, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: held.append(df.count()) or cut(df))
    ranking = spark.range(1000).select(F.lit(1).alias("prompt_id"), F.col("id").alias("entry_idx"), (F.col("id") + 1).cast("int").alias("rank"))
    # prompt 2 only ever repeats its first entry, up to the last of all; prompt 3 ends where its first slice ends
    ranking = ranking.unionByName(spark.range(1000).select(F.lit(2).alias("prompt_id"), (F.col("id") + 5000).alias("entry_idx"), (F.col("id") + 1).cast("int").alias("rank")))
    ranking = ranking.unionByName(spark.range(8).select(F.lit(3).alias("prompt_id"), (F.col("id") + 5000).alias("entry_idx"), (F.col("id") + 1).cast("int").alias("rank")))
    spread = spark.range(1000).select(F.col("id").alias("entry_idx"), F.array(F.cos("id"), F.sin("id")).alias("e"))
    same = spark.range(1000).select((F.col("id") + 5000).alias("entry_idx"), F.when(F.col("id") == 999, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("e"))
    vectors = spread.unionByName(same)
    one = {r["entry_idx"] for r in R.near_dup_thin(ranking.filter("prompt_id = 1"), vectors, k=2, pool=8).collect()}
    assert one == {0, 1} and max(held) == 9
    got = {}
    for r in R.near_dup_thin(ranking, vectors, k=2, pool=250).collect():
        got.setdefault(r["prompt_id"], []).append((r["entry_idx"], r["rank"], r["place"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 1, 1), (1, 2, 2)], 2: [(5000, 1, 1), (5999, 1000, 2)], 3: [(5000, 1, 1)]}
    exact = R.near_dup_thin(ranking.filter("prompt_id = 3"), vectors, k=2, pool=8).collect()
    assert [(r["entry_idx"], r["rank"]) for r in exact] == [(5000, 1)]
