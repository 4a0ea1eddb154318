"""Proofs against trees built in plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from pagewright.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(top, proof steps (at, others) of each leaf)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            ways[leaf].append((i % 8, run[:i % 8] + run[i % 8 + 1:]))
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], ways


def plain(rows):
    """Sorted result rows (doc_id, leaf, subroot, root, proof digest, folded root)."""
    trees = {}
    for r in rows:
        d = dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r))
        leaf = h(*[enc(d[f]) for f in FIELDS])
        changed = leaf
        if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"])
            changed = h(*[enc(d[f] if f != "text" else low) for f in FIELDS])
        trees.setdefault(d["lang"], []).append(((d["doc_id"] is not None, d["doc_id"] or 0, leaf), d["doc_id"], leaf, changed))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [tree([x[2] for x in sorted(trees[t])]) for t in order]
    root, ways = tree([b[0] for b in built])
    out = []
    for t, (sub, own), way in zip(order, built, ways):
        for (_, key, leaf, changed), steps in zip(sorted(trees[t]), own):
            node = changed
            for at, others in steps + way:
                node = h(*others[:at], node, *others[at:])
            out.append((key, leaf, sub, root, h(*[x for _, o in steps + way for x in o]), node))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    low = F.translate("text", merkle.UPPER, merkle.LOWER)
    out = merkle.manifest(df, "doc_id", "lang", FIELDS, {"text": low}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), merkle.folded(F.coalesce("other_leaf", "leaf"), F.col("proof")).alias("f"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_proofs_of_many_trees(spark):
    rnd = random.Random(11)
    langs = [None, "", "a", "de", "en", "en", "en", "en", "é", "zz"]
    rows = [(i, f"Text {i} Äß", rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([None, i])) for i in range(700)]
    rows += [(i, None, "en", None, None) for i in range(-3, 0)] + [(None, t, "en", "s", 1) for t in (None, "", "A")] + [(5, "Same", "de", "s", 4)] * 9
    rows += [(9000, "lone", "only", "s", 4), (9001, "X" * 300_000, "long", "s", None)]
    assert got(spark, rows) == plain(rows)


def test_small_tables_and_one_tree(spark):
    assert got(spark, []) == []
    for n in (1, 2, 8, 9, 65):
        rows = [(i, "T", "en", "s", 1) for i in range(n)]
        assert got(spark, rows) == plain(rows)
    rows = [(i, "T", f"l{i}", "s", 1) for i in range(75)]
    assert got(spark, rows) == plain(rows)


def test_columns_of_other_uses(spark):
    names = ("tree", "pos", "n", "idx", "level", "_place", "_tie", "leaf", "root", "key", "of", "members", "digest")
    rows = [(i, "T", "en", "s", 1, *[7] * len(names)) for i in range(20)]
    assert got(spark, rows, SCHEMA + "".join(f", {c} int" for c in names)) == plain([r[:5] for r in rows])


def test_tampering_is_told(spark):
    rows = [(i, "TeXt" if i % 2 else "text", "en", "s", 1) for i in range(40)]
    for key, leaf, _, root, _, fold in got(spark, rows):
        touched = zlib.crc32(str(key).encode()) % 3 == 0 and key % 2
        assert (fold != root) == bool(touched)
