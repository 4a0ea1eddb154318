"""The join against all pairs compared one by one."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import jaccard


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeXY") for _ in range(rnd.randint(1, 3)))
    rows, passage = [], " ".join(word() for _ in range(12))
    for _ in range(14):
        base = [word() for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 4))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((passage + " " if rnd.random() < 0.3 else "") + " ".join(copy))
    rows += ["a", "A", "a b", "b a", "", None, "\n \t", passage, passage.upper()]
    rnd.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


def test_equals_all_pairs(spark):
    rows = corpus()
    # extra columns with names the operator uses inside
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "keys", "point", "comp", "node", "h", "a", "b", "key")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_slices_and_leaves_lose_nothing(spark, monkeypatch):
    # every cell in slices of three nodes, so that blocks of two slices are searched as well
    monkeypatch.setattr(jaccard, "SLICE", 3)
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60).collect()}
    assert got == brute(rows, 3, 60)


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 200)  # components of several slices as well
    rnd = random.Random(8)
    heap = [f"w{i}" for i in range(60)]
    rows = corpus() + [(10_000 + i, " ".join(f"x{i}" if j == 7 * i % 60 else w for j, w in enumerate(heap))) for i in range(25)]
    rows += [(20_000, " ".join(heap)), (20_001, " ".join(heap)), (20_001, " ".join(heap))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("comp", "node", "slices", "side", "shingles")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(df, 4, 70).collect()}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3)) if w)
    links = {s: sum(100 * len(s & o) >= 70 * len(s | o) for o in set(sets.values()) if o and o != s) if s else 0 for s in set(sets.values())}
    assert {i: x[2] for i, x in got.items()} == {i: links[s] for i, s in sets.items()} and links[sets[20_000]] == 25
    assert {i: x[:2] for i, x in got.items()} == brute(rows, 4, 70)


def test_null_and_repeated_ids_keep_every_link(spark):
    """Rows link one by one; rows of one id belong together; a null id reaches whatever its text is near."""
    rnd = random.Random(9)
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefghijkl"]
    near = lambda t: t.replace("7 ", "7x ", 1)
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, near(texts[1])), (None, near(texts[0])), (None, texts[5]), (None, texts[5]), (None, None), (4, None), (4, texts[6]), (9, texts[6])]
    rows += [(rnd.choice([None, 20, 21, 22, 23, 24, 25]), near(t) if rnd.random() < 0.5 else t) for t in rnd.choices(texts[7:], k=14)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 70, links=False).collect()
    each = brute(list(enumerate(t for _, t in rows)), 4, 70)
    up = {i: root for i, (_, root) in each.items()}
    while True:  # rows of one id belong together
        joined = {}
        for i, (key, t) in enumerate(rows):
            if key is not None and each[i][0]:
                joined.setdefault(key, set()).add(up[i])
        worse = next((x for x in joined.values() if len(x) > 1), None)
        if worse is None:
            break
        up = {i: min(worse) if x in worse else x for i, x in up.items()}
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[up[i]] = min(least.get(up[i], key), key)
    want = sorted(((key, each[i][0], least.get(up[i]) if each[i][0] else key) for i, (key, _) in enumerate(rows)), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert [w for w in want if w[0] in (1, 2, 3)] == [(1, 27, 1), (1, 27, 1), (2, 27, 1), (3, 27, 1)]


def test_empty_table_and_copies(spark):
    one = jaccard.jaccard_components(spark.createDataFrame([(None, "x y"), (1, "x y"), (1, "x y"), (2, "x y")], "doc_id long, text string"), 4, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in one) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), 4, 85).count() == 0


def test_tree_finds_every_point_within_the_bound():
    rng = np.random.default_rng(3)
    points = rng.poisson(2.0, (300, jaccard.AXES)).astype(np.uint32)
    points[150:] = points[:150] + (rng.random((150, jaccard.AXES)) < 0.05)
    sizes = points.sum(axis=1, dtype=np.int64)
    tree = jaccard.RTree(points, sizes)
    for i in range(0, 300, 7):
        bound = jaccard.overlap_bound(points, points[i])
        want = np.flatnonzero(jaccard.may_link(bound, sizes, sizes[i], 85))
        assert sorted(tree.search(points[i], sizes[i], 85).tolist()) == want.tolist() and i in want


def test_fine_points_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)]))
        if len(b):
            assert jaccard.fine_bound(jaccard.fine_point(a), jaccard.fine_point(b)) >= len(np.intersect1d(a, b))
