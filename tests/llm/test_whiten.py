"""Whitened vectors against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    """{vec_id: [(component, n, deviation, whitened, explained)]} of one row per id."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n = len(fit)
    s = [sum(c) for c in zip(*fit)]
    c = np.array(fit, float) - np.array(s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, x in good:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        y = (np.array(x) - np.array(s) / n) @ q
        out.setdefault(i, []).append([(j + 1, n, dev, y[j] / math.sqrt(e[j]), e[j] / e.sum()) for j in range(min(k, len(s))) if e[j] > 1e-12 * e.sum()])
    return out


def check(spark, rows, k=4, near=1e-8):
    got = {}
    for r in whiten.whitened(spark.createDataFrame(rows, SCHEMA), components=k).collect():
        got.setdefault(r["vec_id"], []).append(r)
        assert r["identity_error"] < 1e-9
    want = brute(rows, k)
    assert set(got) == {i for i, w in want.items() if w[0]}
    sign = {}
    for i, each in want.items():
        assert len(got[i]) == sum(map(len, each))
        wanted = each[0]
        for r in sorted(got[i], key=lambda r: r["component"])[::len(each)]:
            c, n, dev, y, part = wanted[r["component"] - 1]
            assert (r["n"], r["deviation"]) == (n, dev)
            assert abs(r["explained"] / part - 1) < 1e-9
            if abs(y) > 1e-3:
                sign.setdefault(c, np.sign(y * r["whitened"]))
            assert abs(r["whitened"] - sign.get(c, 1) * y) < near * (1 + abs(y))


@pytest.mark.parametrize("d,scale", [(1, 1.0), (2, 0.9), (7, 0.8), (24, 0.93)])
def test_against_dense_decomposition(spark, d, scale):
    rnd = np.random.default_rng(d)
    x = rnd.standard_normal((150, d)) * scale ** np.arange(d)[::-1] @ np.linalg.qr(rnd.standard_normal((d, d)))[0]
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])


def test_odd_rows(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rnd.standard_normal(5) * [1, 2, 3, 4, 5]]) for i in range(40)]
    rows += [(100, rows[0][1])] * 200 + [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [-0.0] * 5)]
    check(spark, rows)
    assert {r["vec_id"] for r in whiten.whitened(spark.createDataFrame([*rows, (300, [1.0, 2.0]), (None, [0.5] * 5)], SCHEMA)).collect()} == {*range(40), 100, 205, None}


def test_flat_directions_and_equal_deviations(spark):
    corners = [(i, [3.0 * (i & 1), 3.0 * (i >> 1 & 1), 3.0 * (i >> 2), 1.0]) for i in range(8)]
    rows = whiten.whitened(spark.createDataFrame(corners, SCHEMA)).collect()
    assert len(rows) == 24  # three equal deviations, the fourth direction is flat
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 and r["identity_error"] < 1e-12 for r in rows)
    assert whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 9, SCHEMA)).count() == 0
    assert whiten.whitened(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_entries_and_other_columns(spark):
    rows = [(i, [1e12 * i, 3.0 * (i % 3)]) for i in range(6)]
    got = whiten.whitened(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "v", "n", "component", "data")})).collect()
    assert {r["deviation"] for r in got} == {None} and len(got) == 6
