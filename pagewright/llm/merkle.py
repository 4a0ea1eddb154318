"""Merkle manifest of a dataset with a proof per row, by pointer jumping.

Rows are leaves; the leaves of a tree (rows with one value of ``tree``) ascend by ``key``. Every eight consecutive nodes become
their parent until one is left, the subroot; the subroots, in the order of their trees, become the root the same way.

How Spark deals it out:

1. Places within a tree come from one range sort of the digests and a running sum over (tree, partition) counts, so a tree that
   holds most rows is as spread as any other.
2. A level is one grouping by (tree, place div 8): groups of eight rows, shrinking by eight a level.
3. Each inner node holds the segment of siblings on its way to its parent. A self-join on that ancestor doubles the distance and
   concatenates the segments, so ``log2`` of the height rounds reach the root. Nodes below one ancestor are split by place
   (``SPREAD`` nodes a key), so that a high ancestor is not one hot key. Leaves join last, eight to a row, with their parent's way.

Defined results: a null in any field is ``-`` in its digest; a null tree is a tree of its own and the first; null keys come first;
equal keys go by leaf digest, and equal rows are leaves of their own, each with a proof; columns that are not named are ignored;
an empty table gives an empty result. A tree of one row has its leaf as subroot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FAN = 8
#: Nodes that meet one copy of their ancestor in a self-join.
SPREAD = 64
SEGMENT = "array<struct<at:int,others:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """A value so that concatenations tell values apart: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with the place from 0 within the group (``pos``), the group's size (``n``) and the place of its first row (``tree``), which ascends with the group."""
    place = "_place"
    # equal rows may be many; a number of their own lets the range sort part them
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = cut(tied.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33).alias("_part")
    slices = dealt.groupBy(F.col(group).alias("_group"), part).agg(F.count("*").alias("_c"), F.min(place).alias("_first"))
    one = Window.partitionBy("_group")
    before = one.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_group", "_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(one).alias("n"), F.min("_first").over(one).alias("tree"))
    split = dealt.withColumn("_in", part)
    met = split.join(slices, (split["_in"] == slices["_part"]) & split[group].eqNullSafe(slices["_group"]))
    return met.withColumn("pos", F.col("_before") + F.col(place) - F.col("_first")).select(*rows.columns, "tree", "pos", "n")


def _segment(members: Column, at: Column) -> Column:
    """One step of a proof: the node's place in its run and the digests of the others, left to right."""
    others = F.filter(members, lambda m, i: i != at)
    return F.array(F.struct(at.cast("int").alias("at"), F.array_join(F.transform(others, lambda m: m["digest"]), "").alias("others")))


def climb(nodes: DataFrame, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """From the nodes (tree, idx, n, digest) of a level, ``n`` to a tree: (steps of all nodes that have a parent, the one node left of each tree).

    Steps are (tree, level, idx, seg), what is left is (tree, level, digest).
    """
    steps, tops = [], []
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        tops.append(nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
        runs = cut(
            nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("members"), F.first("n").alias("n"))
        )
        steps.append(runs.select("tree", "members", F.posexplode("members").alias("at", "m")).select(
            "tree", F.lit(level).alias("level"), F.col("m.idx").alias("idx"), _segment(F.col("members"), F.col("at")).alias("seg")))
        nodes = runs.select(
            "tree", F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), joined_digest(F.transform("members", lambda m: m["digest"])).alias("digest"))
        most, level = -(-most // FAN), level + 1
    tops.append(nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
    empty = nodes.sparkSession.createDataFrame([], f"tree long, level int, idx long, seg {SEGMENT}")
    for more in steps:
        empty = empty.unionByName(more)
    left = tops[0]
    for more in tops[1:]:
        left = left.unionByName(more)
    return empty, left


def jump(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(tree, level, idx, seg, subroot) of every node, ``seg`` reaching the root.

    ``ends`` (tree, level, seg, subroot) are the last nodes of the trees with their own way on.
    """
    table = cut(steps.withColumn("subroot", F.lit(None).cast("string")).unionByName(ends.withColumn("idx", F.lit(0).cast("long"))))
    span = table.agg(F.min("level").alias("low"), F.max("level").alias("high")).first()
    low, height = (span["low"], span["high"] - span["low"]) if span["low"] is not None else (0, 0)
    distance = 1
    while distance <= height:
        below = FAN ** distance
        on = table.filter("subroot IS NULL").withColumn("up", F.expr(f"idx div {below}")).withColumn("salt", F.expr(f"idx div {SPREAD}"))
        met = table.filter(F.col("level") >= low + distance).select(
            F.col("tree").alias("_tree"), (F.col("level") - distance).alias("_level"), F.col("idx").alias("_up"), F.col("seg").alias("_seg"), F.col("subroot").alias("_subroot"),
            F.explode(F.sequence(F.expr(f"idx * {below} div {SPREAD}"), F.expr(f"((idx + 1) * {below} - 1) div {SPREAD}"))).alias("_salt"))
        jumped = on.join(met, [on["tree"] == met["_tree"], on["level"] == met["_level"], on["up"] == met["_up"], on["salt"] == met["_salt"]]).select(
            "tree", "level", "idx", F.concat("seg", "_seg").alias("seg"), F.col("_subroot").alias("subroot"))
        table = cut(table.filter("subroot IS NOT NULL").select("tree", "level", "idx", "seg", "subroot").unionByName(jumped))
        distance *= 2
    return table


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""

    def up(node: Column, step: Column) -> Column:
        width = step["at"] * 64
        others = step["others"]
        left = F.substr(others, F.lit(1), width)
        right = F.substr(others, width + 1, F.length(others))
        return F.sha2(F.concat(left, node, right).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    return joined_digest(F.transform(proof, lambda s: s["others"]))


def manifest(rows: DataFrame, key: str, tree: str, fields: list[str], changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, leaf, other_leaf, subroot, root, proof) per row.

    ``fields`` are digested in their order. ``other_leaf`` is the leaf of a row as ``changed`` (new values by field) makes it, where
    ``where`` holds; null elsewhere. ``proof`` lists (place in the run, digests of the others) from the leaf to the root.
    """
    other = row_digest([(changed or {}).get(f, F.col(f)) for f in fields])
    told = cut(rows.select(
        F.col(key).alias("key"), F.col(tree).cast("string").alias("of"), row_digest([F.col(f) for f in fields]).alias("leaf"),
        (F.when(where, other) if where is not None else F.lit(None).cast("string")).alias("other_leaf")))
    leaves = numbered(told, "of", ["key", "leaf"])
    runs = cut(
        leaves.groupBy("tree", F.expr(f"pos div {FAN}").alias("idx"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("leaf").alias("digest"), "other_leaf", "key"))).alias("members"), F.first("n").alias("n"))
        .withColumn("digest", F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(joined_digest(F.transform("members", lambda m: m["digest"]))))
    )
    steps, subroots = climb(runs.select("tree", "idx", F.ceil(F.col("n") / FAN).alias("n"), "digest"))
    subroots = cut(subroots)
    # the trees are the leaves of the last tree
    heads = cut(_heads(subroots))
    top_steps, top = climb(heads.select(F.lit(0).cast("long").alias("tree"), F.col("pos").alias("idx"), "n", "digest"), level=0)
    top = cut(top)
    last = top.first()
    root = F.lit(last["digest"] if last else None).cast("string")
    ways = jump(top_steps, top.select("tree", "level", F.array().cast(SEGMENT).alias("seg"), F.col("digest").alias("subroot"))).filter("level = 0")
    ends = heads.join(ways.select(F.col("idx").alias("pos"), "seg"), "pos").select("tree", "level", "seg", F.col("digest").alias("subroot"))
    full = jump(steps, ends).filter("level = 1").select("tree", "idx", "seg", "subroot")
    out = runs.join(full, ["tree", "idx"]).select("n", "members", "seg", "subroot", F.posexplode("members").alias("at", "m"))
    own = F.when(F.col("n") > 1, _segment(F.col("members"), F.col("at"))).otherwise(F.array().cast(SEGMENT))
    return out.select(
        F.col("m.key").alias(key), F.col("m.digest").alias("leaf"), F.col("m.other_leaf").alias("other_leaf"), "subroot", root.alias("root"),
        F.concat(own, F.col("seg")).alias("proof"))


def _heads(subroots: DataFrame) -> DataFrame:
    """The subroots with their places among all trees (``pos``) and the number of trees (``n``)."""
    placed = numbered(subroots.select(F.col("tree").alias("head"), "level", "digest", F.lit(0).alias("all")), "all", ["head"])
    return placed.select(F.col("head").alias("tree"), "level", "digest", "pos", "n")
