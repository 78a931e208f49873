"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventlens.llm import periodic_runs as runs
from eventlens.llm.common import split_words


def brute(words, min_length=24, repeats=3):
    n, out = len(words), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(min_length, repeats * q) and not smaller:
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    vocabulary, words = rng.choice([1, 2, 3, 5, 50]), []
    while len(words) < rng.randrange(1, 150):
        part = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 12))]
        words += (part * rng.randrange(1, 14))[: rng.randrange(1, 90)] if rng.random() < 0.6 else part
    return words


@pytest.mark.parametrize(("min_length", "repeats"), [(24, 3), (6, 3), (9, 4), (30, 5)])
def test_runs_equal_brute_force(min_length, repeats):
    rng, seen = random.Random(min_length), 0
    for _ in range(400):
        words = repetitive(rng)
        expected = brute(words, min_length, repeats)
        assert runs.text_runs(" ".join(words), min_length, repeats) == (expected, collapsed(words, expected))
        seen += len(expected)
    assert seen > 100


def test_extensions():
    rng = random.Random(3)
    for _ in range(60):
        ids = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(2, 60))] + [0]
        n = len(ids)
        common = runs.Extensions(ids, 7)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        got = common(*map(runs.np.array, zip(*pairs))).tolist()
        expected = [next(k for k in range(n) if ids[a + k] != ids[b + k]) for a, b in pairs]
        assert got == expected
        assert common.order.tolist() == sorted(range(n), key=lambda i: ids[i:])


def edit(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_documents(spark, docs, rows, clashing, empty):
    many = [(i, " ".join(repetitive(random.Random(i)))) for i in range(300)]
    texts = [(d, t) for d, t, *_ in rows if len(t or "") < 20_000] + many
    expected = []
    for d, t in texts:
        words = edit(d, split_words(t))
        found = brute(words)
        best = max(found, key=lambda r: (runs.Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
        expected.append(((d is not None, d or 0), found, best, collapsed(words, found)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    for given in (df, df.withColumns({c: F.lit("x") for c in ("runs", "best", "collapsed", "start", "length", "period", "a", "p")})):
        got = runs.periodic_runs(runs.with_periodic_ends(given)).collect()
        assert sorted(
            ((r.doc_id is not None, r.doc_id or 0), [tuple(x) for x in r.runs], r.best and tuple(r.best), " ".join(split_words(r.collapsed)))
            for r in got) == sorted(expected)
    assert sum(bool(f) for _, f, *_ in expected) > 50
    assert runs.periodic_runs(clashing).count() == len(rows)  # the very long text too
    assert runs.periodic_runs(runs.with_periodic_ends(empty)).count() == 0


def test_one_long_run():
    part = [f"w{i}" for i in range(700)]
    words = ["x"] + part * 40 + part[:13] + ["y"]
    found, left = runs.text_runs(" ".join(words))
    assert found == [(1, 700 * 40 + 13, 700)] and left == " ".join(["x", *part, "y"])
    assert hashlib.sha256(left.encode()).hexdigest() == hashlib.sha256(" ".join(split_words(left)).encode()).hexdigest()
    with pytest.raises(ValueError):
        runs.periodic_runs(None, min_repeats=2)
