"""Whitening against numpy and against exact arithmetic."""

from math import comb, floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import whitening as w

VECTORS = "vec_id bigint, embedding array<float>"


def integers(rows):
    """Rows that take part, with their integer entries."""
    return [(i, [floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]


def check(got, rows, k=16):
    vectors = integers(rows)
    fit = sorted({tuple(x) for _, x in vectors})
    n, x = len(fit), np.array(fit, dtype=object)
    sums = x.sum(axis=0)
    centred = (x - 1_000_000).astype(float) - (sums - n * 1_000_000).astype(float) / n
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    components = min(k, rank)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == components * len(vectors) and {r.n for r in got} == {n}
    order = {tuple(v): np.array([by_id[i][c + 1][0].whitened for c in range(components)]) for i, v in vectors}
    whitened = np.array([order[v] for v in fit])
    spread = (whitened - whitened.mean(axis=0)).T @ (whitened - whitened.mean(axis=0)) / n
    assert np.abs(spread - np.eye(components)).max() < 1e-9
    assert all(r.identity_error < 1e-9 for r in got)
    # whitened = centred @ vector / sqrt(value), so centred.T @ whitened / n = vector * sqrt(value)
    directions = centred.T @ whitened / n
    for c in range(components):
        value = directions[:, c] @ directions[:, c]
        assert abs(value - values[c]) < 1e-9 * values[0]
        unit = directions[:, c] / np.sqrt(value)
        assert np.abs(covariance @ unit - value * unit).max() < 1e-9 * values[0]
    for i, v in vectors:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
        for c, found in by_id[i].items():
            assert {int(r.deviation) for r in found} == {deviation}
            assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-4 * r.explained for r in found)


def gaussian(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(rng.normal(size=(n, d)) * scale)]


@pytest.mark.parametrize(("n", "d"), [(200, 24), (40, 3), (9, 20), (2, 5), (300, 1)])
def test_equals_numpy(spark, n, d):
    rows = gaussian(n, n, d)
    rows += [(1000, None), (1001, [float("nan")] * d), (1002, [float("inf")] + [0.0] * (d - 1)), (1003, [None] * d), (1004, rows[0][1]), (None, rows[1][1])]
    rows += [rows[0]] * 50  # one vector holds a large part
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    check(w.whiten(df).collect(), rows)
    clashing = df.withColumns({c: F.lit("x") for c in ("x", "d", "n", "i", "component", "total")})
    assert w.whiten(clashing).count() == w.whiten(df).count()


def test_equal_roots_and_large_entries(spark):
    d = 6
    corners = [(i, [8.0 if k == i else 0.0 for k in range(d)]) for i in range(d)] + [(d, [0.0] * d)]
    check(w.whiten(spark.createDataFrame(corners, VECTORS)).collect(), corners)
    large = gaussian(5, 60, 4, 1e9)
    check(w.whiten(spark.createDataFrame(large, VECTORS)).collect(), large)


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert w.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    mixed = gaussian(1, 30, 3) + [(99, [1.0] * 5)]  # another length takes no part
    assert {r.vec_id for r in w.whiten(spark.createDataFrame(mixed, VECTORS)).collect()} == set(range(30))


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 12):
        x = rng.integers(-90, 90, size=(d + 3, d)).astype(object)
        matrix = len(x) * x.T.dot(x) - np.outer(x.sum(axis=0), x.sum(axis=0))
        power, expected, identity = np.zeros((d, d), dtype=object), [1], np.eye(d, dtype=int).astype(object)
        for k in range(1, d + 1):  # Faddeev and LeVerrier
            power = matrix.dot(power) + expected[-1] * identity
            expected.append(-sum(matrix.dot(power)[i, i] for i in range(d)) // k)
        e = w.characteristic_polynomial(spark, matrix)
        assert [(-1) ** k * v for k, v in enumerate(e)] == [int(v) for v in expected]


def test_roots_are_counted():
    e = [comb(5, k) * 7**k for k in range(6)]  # 7, five times
    assert [w.roots_above(e, x) for x in (0, 6, 7, 8)] == [5, 5, 0, 0]
    numerator, shift, first, count = w.isolate_root(e, 3)
    assert (first, count) == (0, 5) and abs(numerator / 2**shift - 7) < 1e-12
    assert np.allclose(w.null_vectors((np.eye(5, dtype=int) * 7).astype(object), numerator, shift, count) ** 2 @ np.ones(5), 1)


def test_gram_is_exact():
    rng = np.random.default_rng(1)
    for bits in (5, 20, 21, 45, 62):
        x = rng.integers(-(1 << bits), 1 << bits, size=(200, 3))
        assert (w.exact_gram(x) == x.astype(object).T.dot(x.astype(object))).all()
