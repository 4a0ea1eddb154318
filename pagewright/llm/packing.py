"""Best-fit packing by the configuration linear program over the length histogram.

A sequence's contents are a *pattern* of lengths. The program asks for the fewest patterns that cover every length as
often as it occurs; it depends on the histogram alone, which has at most ``capacity`` entries however many pieces there are.

* Multiplicative weights: a length's weight starts at its length and falls exponentially with the share of it that is covered so far;
  weights are the prices. Scaled by the best pattern's price they solve the dual program, so every round gives a lower bound of the
  number of sequences, and the best of them is kept. Where lengths are many and all patterns come out full, prices near the lengths
  pack better: further solutions let the weight raise the length by a part ``lift`` at most. The fewest sequences win, at a tie those of the pure weights.
* Pricing: the pattern of the highest price, by knapsack dynamic programming over the capacity.
* Rounding: patterns in order of their use, down or up (the better result is kept) and as often as whole pieces remain; what is left
  is best-fit decreasing, also on the histogram.

Pieces are then dealt their places by arithmetic: a piece's number among those of its length names its pattern, the
copy of it and the offset. Numbers come from counts per (partition, length), so a hot length is never in one task, and the
broadcast plan grows with the capacity, not with the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .arrow import as_bytes, binaries, over_batches
from .tokens import WordIds
from .words import text_blocks

ROUNDS = 192
STEP = 0.5
RATE, LIFTED_RATE = 1.0, 4.0


def best_pattern(price: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of lengths of the highest total price that fits: how often each length is taken. ``price[l]`` 0: not on offer."""
    offered = np.flatnonzero(price > 0)
    taken = np.zeros(len(price), np.int64)
    if not len(offered):
        return taken
    most, least = int(offered[-1]), int(offered[0])
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    on = np.where(price > 0, price, -np.inf)
    for c in range(least, capacity + 1):
        top = min(c, most)
        got = on[least:top + 1] + best[c - top:c - least + 1][::-1]
        k = len(got) - 1 - int(got[::-1].argmax())  # of equals the longest, so that short pieces last
        if got[k] > best[c - 1]:
            best[c], last[c] = got[k], least + k
        else:
            best[c] = best[c - 1]
    c = capacity
    while c > 0:
        if last[c]:
            taken[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return taken


def fractional(demand: np.ndarray, capacity: int, lift: float | None, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(pattern, times) of an approximate solution of the linear program, most used first, and the dual bound of its rounds.

    Without ``lift`` the weights alone are the prices; with one they raise the lengths by that part at most.
    """
    lengths, bound = np.arange(len(demand)), 0.0
    covered = np.where(demand > 0, 0.0, 1.0)
    use: dict[bytes, tuple[np.ndarray, float]] = {}
    for _ in range(rounds):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        weight = np.exp(-(RATE if lift is None else LIFTED_RATE) * covered)
        weight /= weight[open_].max()
        price = np.where(open_, lengths * (weight if lift is None else 1 + lift * (lengths / capacity + weight) / 2), 0.0)
        taken = best_pattern(price, capacity)
        bound = max(bound, float(price @ demand) / float(price @ taken))
        on = taken > 0
        left = (1 - covered[on]) * demand[on]
        taken[on] = np.minimum(taken[on], np.maximum(1, np.ceil(left - 1e-9))).astype(np.int64)
        times = float((left / taken[on]).min())
        times = times if times <= 2 else max(1.0, times * STEP)
        covered[on] = np.minimum(1.0, covered[on] + times * taken[on] / demand[on])
        key = taken.tobytes()
        use[key] = (taken, use.get(key, (taken, 0.0))[1] + times)
    return sorted(use.values(), key=lambda x: -x[1]), bound


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: (pattern, copies) with many equal pieces placed at a time."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(pattern: dict[int, int], length: int, k: int, copies: int, space: int) -> None:
        if copies:
            bins.setdefault(space - k * length, []).append((pattern | ({length: k} if k else {}), copies))

    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        for space in sorted(s for s in bins if s >= length):
            groups = bins.pop(space)
            for i, (pattern, copies) in enumerate(groups):
                if not todo:
                    bins.setdefault(space, []).extend(groups[i:])
                    break
                k = space // length
                full = min(copies, todo // k)
                rest = min(k, todo - full * k) if full < copies else 0
                put(pattern, length, k, full, space)
                put(pattern, length, rest, 1 if rest else 0, space)
                put(pattern, length, 0, copies - full - (1 if rest else 0), space)
                todo -= full * k + rest
            if not todo:
                break
        if todo:
            k = capacity // length
            put({}, length, k, todo // k, capacity)
            put({}, length, todo % k, 1 if todo % k else 0, capacity)
    return [g for groups in bins.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, copies) that hold every piece of the histogram exactly once."""
    return bounded_plan(histogram, capacity)[0]


def bounded_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """``plan``, and a number of sequences below which no packing can go: the best dual bound, rounded up."""
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    whole = [({capacity: 1}, int(demand[capacity]))] if demand[capacity] else []
    demand[capacity] = 0
    full = int(sum(c for _, c in whole))
    if not demand.any():
        return whole, full
    found, least = [], 0.0
    for lift, rounds in ((None, ROUNDS), (1 / capacity, ROUNDS), (1 / capacity, ROUNDS // 8), (0.1, ROUNDS)):
        solution, bound = fractional(demand, capacity, lift, rounds)
        least = max(least, bound)
        for whole_times in (np.floor, np.ceil):
            left, used = demand.copy(), []
            for taken, times in solution:
                on = np.flatnonzero(taken)
                copies = int(min(whole_times(times), (left[on] // taken[on]).min()))
                if copies:
                    left[on] -= copies * taken[on]
                    used.append(({int(x): int(taken[x]) for x in on}, copies))
            found.append(used + best_fit(left, capacity))
        if min(sum(c for _, c in x) for x in found) <= np.ceil(least - 1e-6):
            break  # no packing has fewer
    return whole + min(found, key=lambda x: sum(c for _, c in x)), full + int(np.ceil(least - 1e-6))


class Places:
    """Where the piece number ``rank`` of a length goes."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]], capacity: int):
        rows, first = [], 0
        for pattern, copies in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.append((length, first, pattern[length], copies, offset))
                offset += length * pattern[length]
            first += copies
        t = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.first, self.each, self.offset = t[:, 1], t[:, 2], t[:, 4]
        slots = t[:, 2] * t[:, 3]
        self.begin = np.cumsum(slots) - slots
        total = np.zeros(capacity + 2, np.int64)
        np.add.at(total, t[:, 0] + 1, slots)
        self.base = np.cumsum(total)[:-1]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = self.base[length] + rank
        row = np.searchsorted(self.begin, g, side="right") - 1
        copy, place = np.divmod(g - self.begin[row], self.each[row])
        return self.first[row] + copy, self.offset[row] + place * length


def pieces(documents: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): a document's ids and a final 0, cut only where longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit. A null or empty text is the final 0 alone; repeated rows give repeated pieces.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), as_bytes(text_col, "text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for b in batches:
            for row, data, bounds in text_blocks(b.column("text")):
                flat, size = words.ids(data, bounds)
                n = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), n)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(size[owner] - number * capacity, capacity)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(row, len(size)).take(pa.array(owner)), pa.array(number.astype(np.int32)),
                    pa.array(number * capacity), pa.array(length), binaries(flat.astype("<u4").view(np.uint8), length * 4),
                ], ["doc_id", "piece", "start", "length", "ids"])

    return over_batches(docs, read, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids binary")


def pack(table: DataFrame, capacity: int = 2048) -> DataFrame:
    """``table`` (with a column ``length``, 1 to ``capacity``) and ``sequence_id``, ``offset``: gapless from 0 in each sequence."""
    held = cut(table).withColumn("_part", F.spark_partition_id())
    counts = cut(held.groupBy("_part", "length").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    order = Window.partitionBy("_part", "length").orderBy(*[c for c in table.columns if c != "length"])
    ranked = held.withColumn("_rank", F.row_number().over(order) - 1).join(starts, ["_part", "length"])
    sent = table.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity), capacity))
    names = table.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_rank").to_numpy().astype(np.int64) + b.column("_from").to_numpy()
            seq, offset = sent.value.of(b.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
    return over_batches(ranked.select(*names, "_rank", "_from"), deal, f"{kinds}, sequence_id long, offset long")
