"""Secrets against plain Python."""

import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlens.llm import secrets
from tests.llm.conftest import SCHEMA, tuples

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PLAIN = {"assign": ASSIGN, "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def expected(texts):
    """Spans of each text by kind: patterns first, then both chains learned from all texts."""
    rows, random_strings, ordinary = [], [], []
    for text in texts:
        spans = {}
        for kind, pattern in PLAIN.items():
            found = [m for m in pattern.finditer(text) if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]]
            random_strings += [m.group(2) if kind == "assign" else m.group() for m in found]
            spans[kind] = [m.span() for m in found]
        base = [s for found in spans.values() for s in found]
        strings = [m for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", text) if not any(a < m.end() and m.start() < b for a, b in base)]
        ordinary += [m.group() for m in strings if re.fullmatch("[A-Za-z_]+", m.group())]
        rows.append((spans, [m for m in strings if len(m.group()) >= 16]))
    pairs = lambda s: zip(" " + s, s)
    counts = [Counter(p for s in sample for p in pairs(s)) for sample in (ordinary, random_strings)]
    before = [Counter(a for s in sample for a, _ in pairs(s)) for sample in (ordinary, random_strings)]

    def ratio(s):
        share = lambda k, p: (counts[k][p] + 0.5) / (before[k][p[0]] + 0.5 * 65)
        return sum(math.log((0.2 / 65 + 0.8 * share(1, p)) / share(0, p)) for p in pairs(s))

    for spans, strings in rows:
        spans["markov"] = [m.span() for m in strings if random_strings and ordinary and ratio(m.group()) > secrets.THRESHOLD]
    return [spans for spans, _ in rows]


def make_texts():
    rng = random.Random(8)
    syllables = ["tion", "ment", "er", "con", "pre", "ing", "al", "ist", "ver", "sub"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 9)))
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for _ in range(80):
        parts = [word() for _ in range(rng.randrange(5, 60))]
        for make in (
            lambda: f'{rng.choice(["password", "PassWD", "api_key", "APIKEY", "Secret"])}{rng.choice(["=", " : ", chr(34) + ": " + chr(39)])}'
                    + drawn(string.ascii_letters + string.digits + "+/_.=-", rng.randrange(1, 30)),
            lambda: "AKIA" + drawn(string.ascii_uppercase + string.digits, rng.randrange(8, 22)),
            lambda: drawn("0123456789abcdef", rng.randrange(8, 44)),
            lambda: drawn(string.ascii_letters + string.digits, rng.randrange(10, 50)),
            lambda: rng.choice(["日本語 text", "🙂" * 20, "token=token=", "token: secret: abcdefghijkl", "-" * 40, "ſecret=aaaaaaaaaaaaaaaa"]),
        ):
            if rng.random() < 0.4:
                parts.insert(rng.randrange(len(parts)), make())
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    return [*texts, "", "token=abcdefghijkl", "x" * 5000, " ".join(f"secret={drawn('0123456789abcdef', 20)}" for _ in range(700))]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


def spans_of(df):
    return {r.doc_id: {k: [tuple(s) for s in r[k]] for k in secrets.KINDS} for r in secrets.find_secrets(df).collect()}


def test_spans_equal_plain_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    got, wanted = spans_of(df), expected(texts)
    assert [got[i] for i in range(len(texts))] == wanted
    assert all(sum(len(s[k]) for s in wanted) > 15 for k in secrets.KINDS)


def test_strings_held_out(spark, texts):
    """Random strings of letters and digits are told from words that no document holds."""
    rows = secrets.base_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    samples = rows.select(F.col("random").alias("strings"), F.lit(1).alias("label")).unionByName(
        rows.select(F.col("ordinary").alias("strings"), F.lit(0).alias("label")))
    rng = random.Random(99)
    new = [("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24)), True) for _ in range(200)]
    new += [("".join(rng.choice(["ment", "tion", "ver", "ing", "con", "ist", "al"]) for _ in range(8)), False) for _ in range(200)]
    judged = spark.createDataFrame(new, "s string, random boolean").withColumn("weights", secrets.train(samples).scalar())
    right = judged.where((secrets.log_likelihood_ratio(F.col("s"), F.col("weights")) > secrets.THRESHOLD) == F.col("random")).count()
    assert right >= 390


def test_rows_of_any_kind(docs, rows, clashing, empty, spark):
    texts = [t or "" for _, t, *_ in rows]
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(
        (a, secrets.KINDS.index(k), k, b) for k, found in spans.items() for a, b in found))
    wanted = sorted(((d is not None, d or 0), listed(s)) for (d, *_), s in zip(rows, expected(texts)))
    for df in (docs, clashing.withColumns({c: F.lit("x") for c in ("start", "end", "kind", "strings", "weights", "known", "match")})):
        got = secrets.find_secrets(df).select("doc_id", secrets.span_list(*secrets.KINDS).alias("spans")).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), r.spans) for r in got) == wanted
    assert secrets.find_secrets(empty).count() == 0
    alone = spark.createDataFrame([(1, "qX8f" * 9, "", "", 1)], SCHEMA)  # nothing to learn from
    assert tuples(secrets.find_secrets(alone).select(F.size("markov"))) == [(0,)]


def test_running_sums(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 10, 99, 1000):
        numbers = [rng.randrange(100) for _ in range(n)]
        df = spark.createDataFrame([(numbers,)], "a array<bigint>")
        assert df.select(secrets.running_sums(F.col("a"))).first()[0] == [sum(numbers[:i]) for i in range(n)]
