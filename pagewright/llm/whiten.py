"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The fit list (each distinct vector once) is a table of blocks, each a matrix of some thousand vectors. One step of the method is one
Spark job over the blocks: with ``C`` the centred rows, a task works out ``w = C p`` for its rows, its part of ``U' w`` with the
earlier left vectors ``U = C P`` (full reorthogonalisation) and of ``C' w``; Spark adds the parts up. So left vectors, as long as the
table, are never stored or moved, and what comes to the driver is a few vectors as long as an embedding. The small bidiagonal matrix
is decomposed there.

Steps end when the wanted components are settled to double precision or when every direction has been taken. A start vector that
misses a direction (equal deviations) is no trouble: when the recurrence ends early it goes on from a new vector orthogonal to all before.

Defined results: rows whose vector is null, empty, or holds a null, a NaN or an infinity are dropped, and so are rows of another
length than the most frequent one (of equally frequent lengths, the largest stays); repeated rows are fitted once and each returned; null ids
stay; other columns are ignored; components with next to no deviation (1e-12 of the whole, or less) are not returned, so equal vectors or a
single one give no row, as an empty table does. Exact sums that pass a long are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import lists, over_batches

#: Vectors of a block, and bytes of blocks that one task takes at least.
ROWS = 4096
TASK_BYTES = 4 << 20
#: Tasks whose sums meet in one task.
MEET = 256
#: A quantised entry is ``floor(SCALE * entry)``.
SCALE = 256
#: Size of a Lanczos residual, against the gap it must not reach, at which a component counts as settled.
SETTLED = 1e-13
BLOCK_SCHEMA = "rows long, wide boolean, data binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that remain; ``x`` is an array of longs."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (usual["d"] if usual else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(held: list[np.ndarray]) -> pa.RecordBatch:
    """One block of the vectors held, which are let go."""
    m = np.concatenate(held)
    wide = bool((m != m.astype(np.int32)).any())
    held.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array([len(m)], pa.int64()), pa.array([wide]), pa.array([m.astype("<i8" if wide else "<i4").tobytes()], pa.binary())], ["rows", "wide", "data"])


def fit_blocks(x: DataFrame) -> DataFrame:
    """The distinct vectors as blocks (rows, wide, data) of 32-bit entries, or 64-bit ones where a block needs them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        for b in batches:
            m = _matrix(b.column("x")) if b.num_rows else None
            for at in range(0, b.num_rows, ROWS):
                held.append(m[at:at + ROWS])
                if sum(map(len, held)) >= ROWS:
                    yield _packed(held)
        if held:
            yield _packed(held)

    return over_batches(x.select("x").distinct(), pack, BLOCK_SCHEMA)


def gathered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of a written table, and their number of partitions: as many as their bytes call for: a step is a job, and small tables are not worth many tasks."""
    size = blocks.agg(F.sum(F.octet_length("data")).alias("b")).first()["b"] or 0
    wanted = max(1, -(-size // TASK_BYTES))
    now = max(1, blocks.rdd.getNumPartitions())
    if wanted >= now:
        return blocks, now

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for m in _blocks(batches):
            held.append(m.astype(np.int64))
            if sum(map(len, held)) >= ROWS:
                yield _packed(held)
        if held:
            yield _packed(held)

    return cut(over_batches(blocks.coalesce(wanted), merge, BLOCK_SCHEMA)), wanted


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for n, wide, data in zip(b.column("rows").to_pylist(), b.column("wide").to_pylist(), b.column("data")):
            yield np.frombuffer(data.as_buffer(), "<i8" if wide else "<i4").reshape(n, -1)


def summed(blocks: DataFrame, tasks: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all blocks of ``part``, a vector of fixed length: added up in tasks, then ``MEET`` of the ``tasks``' vectors to one where there are more."""
    kind = np.int64 if exact else np.float64

    def packed(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["v"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for m in _blocks(batches):
            total = part(m) if total is None else total + part(m)
        yield from packed(total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("v"):
                v = np.frombuffer(v.as_buffer(), kind)
                total = v if total is None else total + v
        yield from packed(total)

    met = over_batches(blocks, parts, "v binary")
    if tasks > MEET:
        met = over_batches(met.repartition(-(-tasks // MEET)), meet, "v binary")
    met = met.toArrow()
    return sum((np.frombuffer(v.as_buffer(), kind) for v in met.column("v")), np.zeros(1, kind)) if met.num_rows else np.zeros(0, kind)


def _orthogonal(z: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
    return z


def bidiagonalise(blocks: DataFrame, tasks: int, mean: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of the centred rows and their right vectors (as columns)."""
    d = len(mean)
    random = np.random.default_rng(12)
    right, ways = np.zeros((d, 0)), np.zeros((d, 0))  # V, and P with U = C P
    alpha, beta = [], []

    def product(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(w'w, U'w, C'w) of w = C p."""
        both = np.column_stack([ways, p])

        def part(m: np.ndarray) -> np.ndarray:
            c = m - mean
            u = c @ both
            w = u[:, -1]
            return np.concatenate([u.T @ w, c.T @ w])

        got = summed(blocks, tasks, part)
        k = ways.shape[1]
        return got[k], got[:k], got[k + 1:]

    v = random.standard_normal(d)
    v /= np.linalg.norm(v)
    largest = 0.0
    while True:
        right = np.column_stack([right, v])
        p = v - beta[-1] * ways[:, -1] if beta else v
        square, along, back = product(p)
        for _ in range(2):  # against all left vectors; again where little is left
            p = p - ways @ along
            left = square - along @ along
            if left > square / 2:
                back = back - carried @ along if ways.shape[1] else back
                square = left
                break
            square, along, back = product(p)
        a = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, a)
        if a <= 1e-13 * largest or not a:
            a, way, onto = 0.0, np.zeros(d), np.zeros(d)
        else:
            way, onto = p / a, back / a
        ways = np.column_stack([ways, way])
        carried = onto[:, None] if len(alpha) == 0 else np.column_stack([carried, onto])  # C'u of each left vector
        alpha.append(a)
        k = len(alpha)
        z = _orthogonal(onto - a * v, right)
        b = float(np.linalg.norm(z))
        if k == d:
            b = 0.0
        elif b <= 1e-13 * largest or not a:
            z = _orthogonal(random.standard_normal(d), right)
            b, v = 0.0, z / np.linalg.norm(z)
        else:
            v = z / b
        small = np.diag(alpha) + np.diag(beta[:k - 1], 1)
        phi, sigma, psi = np.linalg.svd(small)
        if k == d:
            break
        if k > wanted and b:  # after a fresh start more may be waiting, so such an end settles nothing
            square = np.append(sigma ** 2, 0.0)
            gaps = np.minimum(np.append(np.inf, square[:-2] - square[1:-1])[:wanted], (square[:-1] - square[1:])[:wanted])
            residual = b * sigma[:wanted] * np.abs(phi[-1, :wanted])
            if (residual <= SETTLED * gaps).all():
                break
        beta.append(b)
    vectors = right @ psi.T[:, :min(wanted, d)]
    return sigma[:wanted], vectors


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per remaining row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(vectors, id_col, vector_col)
    blocks, tasks = gathered(cut(fit_blocks(rows)))
    totals = summed(blocks, tasks, lambda m: np.append(m.sum(axis=0, dtype=np.int64), len(m)), exact=True)
    n = int(totals[-1]) if len(totals) else 0
    sums = totals[:-1]
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    mean = np.array([int(s) / n for s in sums])
    trace = float(summed(blocks, tasks, lambda m: np.array([((m - mean) ** 2).sum()]))[0]) / n
    sigma, axes = bidiagonalise(blocks, tasks, mean, components)
    e = sigma ** 2 / n
    keep = e > 1e-12 * trace
    e, axes = e[keep], axes[:, keep]
    if not len(e):
        return vectors.sparkSession.createDataFrame([], schema)
    scaled = axes / np.sqrt(e)
    k = len(e)
    middle = summed(blocks, tasks, lambda m: ((m - mean) @ scaled).sum(axis=0)) / n

    def spread(m: np.ndarray) -> np.ndarray:
        y = (m - mean) @ scaled - middle
        return (y.T @ y).ravel()

    error = float(np.abs(summed(blocks, tasks, spread).reshape(k, k) / n - np.eye(k)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        if len(x) and float(np.abs(x).max()) * n + float(np.abs(sums).max()) < np.sqrt(2.0 ** 62 / x.shape[1]):
            return ((n * x - sums) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            y = (x - mean) @ scaled
            size = np.full(len(x), k)
            number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), pa.array(deviations(x), pa.int64()), lists(number, size, pa.int32()), lists(y.ravel(), size, pa.float64()),
            ], ["vec_id", "deviation", "components", "values"])

    placed = over_batches(rows, place, "vec_id long, deviation long, components array<int>, values array<double>")
    told = F.create_map(*[x for i, v in enumerate(e) for x in (F.lit(i + 1), F.lit(float(v / trace)))])
    return placed.select("vec_id", "deviation", F.explode(F.arrays_zip("components", "values")).alias("c")).select(
        "vec_id", F.col("c.components").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c.values").alias("whitened"),
        told[F.col("c.components")].alias("explained"), F.lit(error).alias("identity_error"))
