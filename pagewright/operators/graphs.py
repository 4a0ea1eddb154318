"""Connected components: bounded slices of a group's edges first, then rounds of joins for groups of several slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_empty

#: Edges of a group that one task takes at once.
SLICE_EDGES = 1 << 17


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str], slice_edges: int = SLICE_EDGES) -> DataFrame:
    """(by..., node, comp): the smallest node each node is connected to inside its group.

    ``nodes`` has (by..., node), ``edges`` (by..., a, b). The edges of a group are dealt into slices of about ``slice_edges``, and
    each slice is replaced by stars round its smallest nodes. A group of one slice is done then, so the number of jobs does not
    grow with its longest chain; only groups of several slices, and nodes without a group, go through rounds, see ``_rounds``.
    """
    pairs = cut(edges.filter("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    root = _sliced(pairs, by, slice_edges) if by else _rounds(pairs, by)
    root = root.select(*by, F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.select(*by, "node").join(root, [*by, "node"], "left").withColumn("comp", F.coalesce("comp", "node"))


def _sliced(pairs: DataFrame, by: list[str], slice_edges: int) -> DataFrame:
    """(by..., a, b): every node that is not the smallest of its component with the smallest."""
    slices = F.ceil(F.count("*") / slice_edges).cast("int")
    dealt = pairs.join(pairs.groupBy(*by).agg(slices.alias("_slices")), by).withColumn(
        "_slice", F.when(F.col("_slices") > 1, F.expr("cast(pmod(xxhash64(a, b), _slices) AS int)")).otherwise(0))

    def stars(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        ids, at = np.unique(np.concatenate([rows.column("a").to_numpy(), rows.column("b").to_numpy()]), return_inverse=True)
        least = least_connected(len(ids), at[:n], at[n:])
        other = np.flatnonzero(least != np.arange(len(ids)))
        group = rows.select([*by, "_slices"]).take(np.zeros(len(other), np.int64))
        return group.append_column("a", pa.array(ids[other])).append_column("b", pa.array(ids[least[other]]))

    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_slices int", f"a {kinds['a']}", f"b {kinds['b']}"])
    found = cut(dealt.groupBy(*by, "_slice").applyInArrow(stars, schema))
    whole, parts = found.filter("_slices = 1").drop("_slices"), found.filter("_slices > 1").drop("_slices")
    return whole if is_empty(parts) else whole.unionByName(_rounds(parts, by))


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` numbers each is connected to: roots are hung below smaller ones and all paths flattened, until no edge joins two roots."""
    up = np.arange(n)
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            return up
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def _rounds(pairs: DataFrame, by: list[str]) -> DataFrame:
    """As ``_sliced``, by joins alone.

    Alternates two star contractions: every node
    hands its larger neighbours, then its smaller ones, to the smallest node it knows. A long chain halves
    each round, and a hub is only ever the key of a minimum, which combines before the shuffle. Each
    round is checkpointed to the shared folder.
    """
    mark = _mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*by, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(low, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*by, "a"]).select(*by, F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select(*by, "e.a", "e.b").filter("a <> b").distinct()
        pairs = cut(small)
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    return pairs.groupBy(*by, "a").agg(F.min("b").alias("b"))


def _mark(pairs: DataFrame) -> tuple:
    """A fingerprint of an edge set: the rounds stop when it no longer changes."""
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64(*pairs.columns)), F.sum(F.xxhash64(*pairs.columns) % 1_000_003)).first()
    return tuple(row)
