"""N-gram Jaccard join: a count-vector R-tree.

Shingles are hashed into groups; the number of a document's distinct shingles per group is a point. The sum of
coordinate minima of two points bounds their overlap from above, and of a box's upper corner and a point bounds
it for all points of the box. Pairs that survive the bound are verified on the whole shingle sets.

How Spark deals the work out, so that no pair that links is lost:

1. Rows are judged by a row key, as ids may be null or repeat. Rows with equal sets are one *node* (one row speaks for them); copies are never paired.
2. Two linked sets share a shingle among the ``n - ceil(t n) + 1`` first of each, in any order of shingles that all
   documents agree on. The order here puts shingles of crowded hash groups last (a count of fixed size over the
   corpus), so that a passage that many documents share is a key only of documents that hold little else.
   Nodes that share such a key form a *cell*.
3. First each node is compared with the smallest node it shares any cell with: one pair a node. Then, only where components still meet in a
   cell, a node is compared with the cell's hub, of whose keys the largest share lies in cells: a text that others were copied from, with changes, shares
   all its keys, a changed copy only some. Only cells that hold several components even then go through the R-tree, in
   slices of bounded size, and only between components. So a heap of near copies costs a star, not all its pairs.
   Cells of the same nodes are one cell, and a pair is let through only where the key can be the first that the two sets share: what
   follows it in both must still suffice. Two sets that link pass at their first shared key, so later ones need not report them again.
4. Components need a spanning set of links only. Where all links of a node are to be counted (``links=True``), each component
   is cut into slices of bounded bytes, and each pair of slices is met once, in one task, which counts exact overlaps by an
   inverted index and adds up links per node. That costs all pairs of a component, but no pair is emitted.

Results, one per row: documents without a word are alone; nulls count as empty; rows of one id belong together and link by each of their
texts; a row without an id links like any other, and its ``component_id`` is the smallest id it reaches, null if there is none; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from ..session import cut
from . import bloom
from .arrow import as_bytes, binaries, lists, over_batches
from .rows import keyed
from .words import SpanHash, grams, lower_table, mix, space_separated, spans, text_blocks

#: Hash groups of a point, and of the corpus count that orders shingles.
AXES = 64
CROWDS = 1 << 17
#: Nodes of a cell that one task takes as a slice, and points of an R-tree leaf.
SLICE = 2048
LEAF = 16
#: Shingle hashes of a component that one task takes as a slice when links are counted: 4 MB.
COUNTED = 1 << 19
#: Bits of the filters that spare rows a shuffle: 8 MB, whatever the corpus.
KEY_BITS = 1 << 26


class Shingler:
    """Distinct shingle hashes of the texts of a block."""

    def __init__(self, k: int):
        self.k, self.lower, self.table, self.hasher = k, lower_table(), space_separated(), SpanHash()

    def sets(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, text numbers), by text and hash; a text of fewer than ``k`` words is one shingle."""
        low = self.lower[data]
        s, e, text = spans(low, bounds, self.table)
        if not len(s):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words = self.hasher.of(self.hasher.sums(low), s, e)
        h, at = grams(words, text, self.k)
        owner = text[at]
        count = np.bincount(text, minlength=len(bounds) - 1)
        short = (count > 0) & (count < self.k)
        if short.any():
            for m in range(1, self.k):
                g, where = grams(words, text, m)
                keep = count[text[where]] == m
                h, owner = np.concatenate([h, g[keep]]), np.concatenate([owner, text[where][keep]])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return h[new], owner[new]


def _crowds(docs: DataFrame, k: int) -> np.ndarray:
    """How crowded each of ``CROWDS`` hash groups is: 0 for what chance explains, then a step per doubling. 128 KB."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(k), np.zeros(CROWDS, np.int64)
        for b in batches:
            for _, data, bounds in text_blocks(b.column("text")):
                h, _ = shingler.sets(data, bounds)
                total += np.bincount((h % np.uint64(CROWDS)).astype(np.int64), minlength=CROWDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["crowd", "n"])

    rows = over_batches(docs.select("text"), count, "crowd int, n long").groupBy("crowd").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CROWDS)
    total[rows["crowd"].to_numpy(np.int64)] = rows["n"].to_numpy()
    usual = np.median(total) + 8 * np.sqrt(np.median(total) + 1) + 8
    return np.ceil(np.log2(np.maximum(total / usual, 1))).astype(np.uint8)


def _points(docs: DataFrame, k: int, percent: int, crowds: np.ndarray) -> DataFrame:
    """(doc_id, id, n, s1, s2, point, keys) per row of (doc_id, id, text); ``doc_id`` is the row's key, ``id`` its id."""
    sent = docs.sparkSession.sparkContext.broadcast(crowds)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, crowd = Shingler(k), sent.value
        for b in batches:
            for row, data, bounds in text_blocks(b.column("text")):
                docs_here = len(bounds) - 1
                h, owner = shingler.sets(data, bounds)
                n = np.bincount(owner, minlength=docs_here)
                first = np.concatenate([[0], np.cumsum(n)])[:-1]
                sums = np.zeros((2, docs_here), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    sums[0, full] = np.add.reduceat(mix(h), first[full])
                    sums[1, full] = np.add.reduceat(mix(h + np.uint64(77)), first[full])
                axis = (h >> np.uint64(40)) % np.uint64(AXES)
                point = np.bincount(owner * AXES + axis.astype(np.int64), minlength=docs_here * AXES).astype(np.uint32)
                order = np.lexsort((h, crowd[(h % np.uint64(CROWDS)).astype(np.int64)], owner))
                reach = n - (percent * n + 99) // 100 + (n > 0)
                place = np.arange(len(h)) - np.repeat(first, n)
                keys = h[order][place < np.repeat(reach, n)]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(row, docs_here), b.column("id").slice(row, docs_here), pa.array(n.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    binaries(point.view(np.uint8), np.full(docs_here, AXES * 4)),
                    lists(keys.view(np.int64), reach, pa.int64()),
                ], ["doc_id", "id", "n", "s1", "s2", "point", "keys"])

    return over_batches(docs, measure, "doc_id long, id long, n long, s1 long, s2 long, point binary, keys array<long>")


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points (or of a box's upper corners and points), row by row."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def may_link(bound: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of at most ``bound`` can still reach ``percent`` of the union."""
    return (100 + percent) * bound >= percent * (na + nb)


class RTree:
    """Points packed by size and then by their largest spread, in leaves with upper corners; levels of ``LEAF`` children."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.var(axis=0).argsort()[::-1][:2] if len(points) else [0, 0]
        width = max(LEAF, int(np.sqrt(len(points) * LEAF)))
        by_size = np.lexsort((points[:, spread[0]], sizes))
        strip = np.empty(len(points), np.int64)
        strip[by_size] = np.arange(len(points)) // width
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], strip))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low = self.points, self.sizes
        while len(top) > LEAF or not self.levels:
            cuts = np.arange(0, len(top), LEAF)
            top, low = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(low, cuts)
            self.levels.append((top, low))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points whose overlap bound with ``point`` allows a link."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -2, -1):
            top, low = self.levels[depth] if depth >= 0 else (self.points, self.sizes)
            at = at[at < len(top)]
            at = at[may_link(overlap_bound(top[at], point), low[at], size, percent)]
            if depth >= 0:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[at]


def _nodes(filled: DataFrame, reps: DataFrame) -> DataFrame:
    """The one row of ``filled`` that speaks for each distinct set. Rows whose set occurs once are told by a filter and do not move."""
    twice = reps.filter("copies > 1")
    alone, rest = bloom.parted(filled, [F.col("s1")], bloom.build(twice.select(F.col("s1").alias("h")), "h", KEY_BITS))
    return alone.unionByName(rest.join(reps.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))


def _postings_among(nodes: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, key, place, share) for the keys that may be among those of the filter ``wanted``.

    ``place`` tells how many of the set's shingles precede the key, ``share`` how much of the set's keys the filter lets through.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            many = keys.value_lengths().to_numpy()
            owner = np.repeat(b.column("doc_id").to_numpy(), many)
            flat = keys.flatten().to_numpy()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            ok = bloom.holds(sent.value, flat)
            held = np.bincount(np.repeat(np.arange(len(many)), many), weights=ok, minlength=len(many)) / np.maximum(many, 1)
            share = np.repeat(held.astype(np.float32), many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[ok]), pa.array(flat[ok]), pa.array(place[ok].astype(np.int32)), pa.array(share[ok])], ["doc_id", "key", "place", "share"])

    return over_batches(nodes.select("doc_id", "keys"), read, "doc_id long, key long, place int, share float")


def _within(points: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points allow a link."""
    both = (
        pairs.join(points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), "a")
        .join(points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pa_, pb_ = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, AXES) for c in ("pa", "pb"))
            ok = may_link(overlap_bound(pa_, pb_), b.column("na").to_numpy(), b.column("nb").to_numpy(), percent)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return over_batches(both, keep, "a long, b long, na long, nb long")


def _of_wanted(docs: DataFrame, k: int, wanted: DataFrame, name: str, form) -> DataFrame:
    """(doc_id, ``name``) of the documents ``wanted`` (doc_id) names: ``form`` of each one's shingle hashes.

    A fixed-size filter spares the other documents the work.
    """
    filled = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select(F.xxhash64("doc_id").alias("h")), "h"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            b = b.filter(pa.array(bloom.holds(filled.value, b.column("h").to_numpy())))
            for row, data, bounds in text_blocks(b.column("text")):
                h, owner = shingler.sets(data, bounds)
                cuts = np.searchsorted(owner, np.arange(len(bounds)))
                out = [form(h[x:y]).tobytes() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(out)), pa.array(out, pa.binary())], ["doc_id", name])

    named = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return over_batches(named, read, f"doc_id long, {name} binary").join(wanted, "doc_id", "left_semi")


def fine_point(h: np.ndarray) -> np.ndarray:
    """A point with about four shingles to an axis; axes are low bits, so that a finer point folds into a coarser one."""
    axes = 1 << max(3, int(np.ceil(np.log2(max(1, len(h)) / 4))))
    return np.bincount((h & np.uint64(axes - 1)).astype(np.int64), minlength=axes).astype("<u2")


def fine_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Summed coordinate minima of two fine points, on the axes of the coarser."""
    axes = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, axes).sum(axis=0, dtype=np.int64), y.reshape(-1, axes).sum(axis=0, dtype=np.int64)).sum())


def _paired(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    return pairs.join(values.select(F.col("doc_id").alias("a"), F.col(name).alias("va")), "a").join(
        values.select(F.col("doc_id").alias("b"), F.col(name).alias("vb")), "b")


def _keep_pairs(both: DataFrame, kind: str, links) -> DataFrame:
    """The pairs (a, b) whose values, read as arrays of ``kind``, satisfy ``links``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [links(np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)) for x, y in zip(batch.column("va"), batch.column("vb"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return over_batches(both, check, "a long, b long")


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``members`` (doc_id, key, place, share, c, a) of cells that hold several components, with their component and the cell's ``hub`` (its doc_id and comp).

    Of cells with the same nodes, told by two sums of their ids' hashes, that of the first key stays: all sets have their keys in one order.
    """
    placed = members.join(comp.withColumnRenamed("node", "doc_id"), "doc_id")
    told = placed.groupBy("key").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("place", "doc_id").alias("place"),
        F.max_by(F.struct("doc_id", "comp"), F.struct("share", "doc_id")).alias("hub"),
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("h2"))
    cells = told.filter("x <> y").groupBy("n", "h1", "h2").agg(F.min_by(F.struct("key", "hub"), "place").alias("cell")).select("cell.*")
    return cut(placed.join(cells, "key"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _linked(docs: DataFrame, k: int, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by fine points, a sixteenth of the bytes, then by whole shingle sets."""

    def may(x: np.ndarray, y: np.ndarray) -> bool:
        return bool(may_link(fine_bound(x, y), x.sum(dtype=np.int64), y.sum(dtype=np.int64), percent))

    def does(x: np.ndarray, y: np.ndarray) -> bool:
        one = np.sort(np.concatenate([x, y]))
        same = int(np.count_nonzero(one[1:] == one[:-1]))
        return 100 * same >= percent * (len(x) + len(y) - same)

    pairs = cut(pairs)
    near = cut(_keep_pairs(_paired(pairs, _of_wanted(docs, k, cut(_ends(pairs)), "fine", fine_point), "fine"), "<u2", may))
    sets = _of_wanted(docs, k, cut(_ends(near)), "shingles", lambda h: h)
    return cut(_keep_pairs(_paired(near, sets, "shingles"), "<u8", does))


def _by_block(names: tuple[str, ...], block):
    """A function of batches sorted by ``names`` that gives ``block`` the tables of each run of equal values, one run at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for b in batches:
            t = pa.Table.from_batches([b])
            ids = np.stack([t.column(c).to_numpy() for c in names])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                this = tuple(ids[:, x])
                if this != now and held:
                    yield block(held)
                    held = []
                now = this
                held.append(t.slice(x, y - x))
        if held:
            yield block(held)

    return run


def _search(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that the R-tree lets through, from rows (key, lo, hi, side, doc_id, n, place, comp, point).

    A block (key, lo, hi) holds one or two slices of a cell; sorted partitions are read run by run.
    """

    def block(rows: pa.Table) -> np.ndarray:
        ids, n, comp, side, place = (rows.column(c).to_numpy() for c in ("doc_id", "n", "comp", "side", "place"))
        rest = n - place  # the key and what follows it
        points = np.frombuffer(b"".join(rows.column("point").to_pylist()), np.uint32).reshape(-1, AXES)
        tree, out = RTree(points, n), []
        whole = (side == 0).all()
        sizes = np.unique(comp, return_counts=True)
        largest = sizes[0][sizes[1].argmax()]
        for i in range(len(ids)) if whole else np.flatnonzero(side == 1):
            if whole and comp[i] == largest:  # met by every other component's query
                continue
            j = tree.search(points[i], n[i], percent)
            j = j[(comp[j] != comp[i]) & may_link(np.minimum(rest[j], rest[i]), n[j], n[i], percent)]
            j = j[(comp[j] == largest) | (j < i)] if whole else j[side[j] == 2]
            out.append(np.stack([np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def found(held: list[pa.Table]) -> pa.RecordBatch:
        got = block(pa.concat_tables(held))
        return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return over_batches(dealt, _by_block(("key", "lo", "hi"), found), "a long, b long").distinct()


def _link_counts(docs: DataFrame, k: int, percent: int, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, n_links): how many nodes each node links with. All links lie within components, and each pair of a component is met in one block."""
    told = nodes.select(F.col("doc_id").alias("node"), "n").join(comp, "node")
    sizes = told.groupBy("comp").agg(F.count("*").alias("c"), F.ceil(F.sum("n") / COUNTED).cast("int").alias("slices")).filter("c > 1")
    told = cut(told.join(sizes, "comp").select(F.col("node").alias("doc_id"), "comp", "slices"))
    sets = _of_wanted(docs, k, told.select("doc_id"), "shingles", lambda h: h)
    rows = (
        sets.join(told, "doc_id")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side"), "doc_id", "shingles")
    )

    def block(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        ids, side = t.column("doc_id").to_numpy(), t.column("side").to_numpy()
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        n = np.array([len(x) for x in each], np.int64)
        owner, flat = np.repeat(np.arange(len(ids)), n), np.concatenate(each)
        order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[order][1:] != flat[order][:-1]
        group = np.empty(len(flat), np.int64)
        group[order] = np.cumsum(new) - 1
        holders, first = owner[order], np.append(np.flatnonzero(new), len(flat))
        begin = np.concatenate([[0], np.cumsum(n)])
        degree = np.zeros(len(ids), np.int64)
        for i in range(len(ids)):
            g = group[begin[i]:begin[i + 1]]
            many = first[g + 1] - first[g]
            at = np.repeat(first[g] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            same = np.bincount(holders[at], minlength=len(ids))
            link = 100 * same >= percent * (n + n[i] - same)
            link[i] = False
            if side[i]:
                link &= side != side[i]
            degree[i] = np.count_nonzero(link)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree)], ["node", "n_links"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return over_batches(dealt, _by_block(("comp", "lo", "hi"), block), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(documents: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                       links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of ``documents``; ``n_links`` only with ``links``.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their distinct ``k``-word shingles;
    ``component_id`` is the smallest id reachable by links, ``n_links`` the number of different sets that the document's set links with.
    """
    docs = keyed(documents.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col, "text")), "doc_id")
    points = cut(_points(docs, k, percent, _crowds(docs, k)))
    filled = points.filter("n > 0")
    reps = cut(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies")))
    nodes = cut(_nodes(filled, reps))
    postings = nodes.select("doc_id", F.explode("keys").alias("key"))
    shared = cut(postings.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("c > 1"))
    wide = shared.filter("c > 2").select("key", "c", "a")
    members = cut(_postings_among(nodes, bloom.build(wide, "key", KEY_BITS)).join(wide, "key"))
    twos = cut(shared.filter("c = 2").select("a", F.col("z").alias("b")).distinct())
    rays = members.filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    small = nodes.select("doc_id", "n", "point")
    ids = reps.select("node")
    # one pair a node: the smallest node it meets
    one = cut(twos.unionByName(rays).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    spanning = _linked(docs, k, _within(small, one, percent).select("a", "b"), percent)
    comp = cut(connected_components(ids, spanning, []))
    # then what that left apart, in the cells where components still meet
    apart = _open(members, comp)
    of = comp.withColumnRenamed("comp", "other")
    pairs = twos.join(comp, twos["b"] == comp["node"]).drop("node").join(of, F.col("a") == of["node"]).filter("comp <> other").select("a", "b")
    star = cut(pairs.unionByName(apart.filter("comp <> hub.comp").select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"))).distinct().join(one, ["a", "b"], "left_anti"))
    if not star.isEmpty():
        spanning = spanning.unionByName(_linked(docs, k, _within(small, star, percent).select("a", "b"), percent))
        comp = cut(connected_components(ids, spanning, []))
        apart = _open(apart.drop("comp", "hub"), comp)
    slices = F.ceil(F.col("c") / SLICE).cast("int")
    cells = (
        apart.join(small, "doc_id")
        .withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("comp", "doc_id"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side"),
                "doc_id", "n", "place", "comp", "point")
    )
    more = cut(_search(cells, percent).join(one.unionByName(star), ["a", "b"], "left_anti"))
    linked = spanning
    if not more.isEmpty():
        linked = linked.unionByName(_linked(docs, k, more, percent))
    same = _of_one_id(filled, reps)
    if not more.isEmpty() or not same.isEmpty():
        comp = connected_components(ids, linked.unionByName(same), [])
    told = reps.join(comp, "node")
    least = told.groupBy("comp").agg(F.min("least").alias("component"))
    verdict = told.join(least, "comp").select("s1", "s2", "component", "node")
    out = [F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")]
    if links:
        verdict = verdict.join(_link_counts(docs, k, percent, nodes, comp), "node", "left")
        out.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # rows without a word have sums of their own accord and meet nothing
    met = points.select("id", "n", "s1", "s2").withColumn("r1", F.when(F.col("n") > 0, F.col("s1"))).drop("s1")
    return met.join(verdict.withColumnRenamed("s1", "r1"), ["r1", "s2"], "left").select(F.col("id").alias("doc_id"), *out)


def _of_one_id(filled: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) that hold the different sets of one id together: each with the one of the smallest hash."""
    of_id = filled.filter("id IS NOT NULL").select("id", F.struct("s1", "s2").alias("s"))
    several = of_id.groupBy("id").agg(F.min("s").alias("first"), F.max("s").alias("last")).filter("first <> last")
    sets = of_id.join(several, "id").filter("s <> first").select("s", "first").distinct()
    names = reps.select(F.struct("s1", "s2").alias("s"), "node")
    return cut(sets.join(names.select("s", F.col("node").alias("b")), "s").join(names.select(F.col("s").alias("first"), F.col("node").alias("a")), "first").select("a", "b"))
