"""Nearest vectors against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import nearest_vectors


def brute(vectors, nearest=20):
    found = {}
    usable = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in usable:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in usable if i != q and len(w) == len(v))
            found[q] = [(i, -s) for s, i in scored[:nearest]]
    return found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    out = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    out += [(i, out[5][1]) for i in range(600, 900)]  # a vector with very many copies, queries among them
    out += [(1000, None), (1020, [0.0] * 16), (1040, [1.0, None] * 8), (1060, [float("nan")] * 16), (1080, [float("inf")] * 16), (1100, [])]
    out += [(None, out[0][1]), (2000, [1.0, 2.0]), (2001, [2.0, 1.0])]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest(spark, vectors, kind):
    df = spark.createDataFrame(vectors, f"vec_id bigint, embedding array<{kind}>").withColumns({"query": F.lit(1), "class": F.lit(2), "vector": F.lit(3)})
    got = defaultdict(list)
    for r in nearest_vectors.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = brute(vectors)
    assert set(got) == set(expected)
    hit = sum(len({x[1] for x in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hit >= 0.9 * sum(map(len, expected.values()))
    for q, listed in got.items():
        assert [x[0] for x in listed] == list(range(1, len(listed) + 1)) and len(listed) == len(expected[q])
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(listed, listed[1:]))
    assert got[620][0][1] == 5 and [x[1] for x in got[620]][1:3] == [600, 601]  # equal scores: smaller ids first
    assert [x[1] for x in got[2000]] == [2001]


@pytest.mark.parametrize("norms", ["one longer", "lognormal", "opposite"])
def test_recall_with_skewed_norms(spark, monkeypatch, norms):
    """14 probes in hashed ranges, whatever the norms; queries that look away from all vectors are served as well."""
    monkeypatch.setattr(nearest_vectors, "CANDIDATES", 300)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one longer":
        x[7] *= 1000
    elif norms == "lognormal":
        x *= np.exp(0.5 * rng.normal(size=(4000, 1)))
    else:
        x = 0.05 * x + np.eye(32)[0]
        x[:100:20] *= -1  # five of the queries
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = defaultdict(set)
    for r in nearest_vectors.nearest(df, probes=14).collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 4000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert len(found[q]) == 20
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.95 * 20 * 200


def test_no_vectors(spark):
    assert nearest_vectors.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_hadamard_keeps_lengths_and_inner_products():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = nearest_vectors.rotated(x, 3)
    assert np.allclose(x @ x.T, y @ y.T)
    a, b = nearest_vectors.padded(x, 20.0, False), nearest_vectors.padded(x, 20.0, True)
    assert np.allclose(np.linalg.norm(a, axis=1), 1) and np.allclose(b @ a.T * np.linalg.norm(x, axis=1)[:, None] * 20, x @ x.T)
