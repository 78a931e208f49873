"""Quality rules, quality classifier and toxicity."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from eventlens.llm import quality_classifier, quality_rules, toxicity
from eventlens.llm.common import split_words
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again)


def test_split_words(rows):
    for text in [t for _, t, *_ in rows] + ["\x1ca\x1f b", "a\x0bb\x0cc\rd"]:
        assert split_words(text) == WORD.findall(text or "")


def test_base_counts(docs, rows, clashing, empty):
    for df in (docs, clashing):
        got = quality_rules.rule_quality(df).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), *tuple(r)[1:6]) for r in got) == sorted(
            ((d is not None, d or 0), *base(t)) for d, t, *_ in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed) and 0 <= r.quality_probability <= 1
    assert quality_rules.rule_quality(empty).count() == 0


def em(patterns, n, iterations):
    """The same EM in plain Python."""
    start = quality_rules.START
    prior, rules = quality_rules.START_PRIOR, [dict(start) for _ in range(n)]
    votes = quality_rules.PRIOR_VOTES

    def posterior(p):
        odds = np.log(prior / (1 - prior))
        for v, r in zip(p, rules):
            good, bad = {1: (r["good_if_good"], r["good_if_bad"]), -1: (r["bad_if_good"], r["bad_if_bad"]), 0: (
                1 - r["good_if_good"] - r["bad_if_good"], 1 - r["good_if_bad"] - r["bad_if_bad"])}[v]
            odds += np.log(good / bad)
        return 1 / (1 + np.exp(-odds))

    for _ in range(iterations):
        good = {p: c * posterior(p) for p, c in patterns.items()}
        bad = {p: c - good[p] for p, c in patterns.items()}
        g, b = sum(good.values()), sum(bad.values())
        rules = [{
            "good_if_good": (sum(x for p, x in good.items() if p[j] == 1) + votes * start["good_if_good"]) / (g + votes),
            "bad_if_good": (sum(x for p, x in good.items() if p[j] == -1) + votes * start["bad_if_good"]) / (g + votes),
            "good_if_bad": (sum(x for p, x in bad.items() if p[j] == 1) + votes * start["good_if_bad"]) / (b + votes),
            "bad_if_bad": (sum(x for p, x in bad.items() if p[j] == -1) + votes * start["bad_if_bad"]) / (b + votes),
        } for j in range(n)]
        prior = (g + votes * quality_rules.START_PRIOR) / (g + b + votes)
    return {p: posterior(p) for p in patterns}


def test_em(docs):
    got = quality_rules.rule_quality(docs).collect()
    patterns = Counter(tuple(r.votes) for r in got)
    expected = em(patterns, len(quality_rules.RULES), quality_rules.ITERATIONS)
    for r in got:
        assert r.quality_probability == pytest.approx(expected[tuple(r.votes)], abs=1e-9)


def test_rules_part_junk_from_prose(spark):
    rng = random.Random(2)
    prose = [" ".join(words(rng, 120, 3000)) + "." for _ in range(200)]
    junk = [" ".join(f"{w}***" for w in words(rng, 120, 3000)) for _ in range(12)]
    junk += [" | ".join(words(rng, 120, 3000)) for _ in range(12)]
    junk += [" ".join(w.upper() + "!!" for w in words(rng, 120, 3000)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.rule_quality(df).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in range(200, 236))


def labelled(spark, texts, name):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], f"doc_id bigint, {name} int")
    return docs, labels


def test_quality_classifier(spark, docs, clashing, empty, rows):
    rng = random.Random(4)
    texts = [(" ".join(words(rng, 40)), 1) for _ in range(200)]
    texts += [(" ".join(f"{w}!!" if k % 2 else f"{w.upper()}##" for k, w in enumerate(words(rng, 40))), 0) for _ in range(60)]
    texts += [("again " * 40, 0)] * 20
    d, labels = labelled(spark, texts, "quality")
    got = quality_classifier.score_quality(d, labels).collect()
    held = [r for r in got if r.held_out]
    assert 30 < len(held) < 90 and all(r.predicted == texts[r.doc_id][1] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    for df in (docs, clashing):
        scored = quality_classifier.score_quality(df, labels).collect()
        assert len(scored) == len(rows)
    assert quality_classifier.score_quality(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 7)], "doc_id bigint, quality int")
    assert {r.score for r in quality_classifier.score_quality(docs, odd).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    ratios = rng.normal(size=30)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 1.0)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / (np.sqrt((ratios[r] ** 2).sum()) or 1)
        x[i, 30] = 1

    def primal(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    scaled, bias = quality_classifier.dual_coordinate_descent(rows, y, ratios, cost, 2000)
    w = np.append(scaled / ratios, bias)
    best = primal(w)
    assert all(primal(w + rng.normal(scale=s, size=31)) >= best - 1e-3 for s in (0.01, 0.1, 1) for _ in range(200))


def test_restoring():
    rng = random.Random(1)
    corpus = ["the idiot is a stupid loser", "a moron and the idiot", "trash talk of a pathetic clown"] * 50
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([*corpus, None, ""])], names=["text"])
    counted = next(toxicity._count_trigrams(iter([batch])))
    counts = np.zeros(64**3)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    model = np.log((counts.reshape(64 * 64, 64) + 0.01) / (counts.reshape(64 * 64, 64).sum(axis=1, keepdims=True) + 0.64)).reshape(-1).tolist()
    for disguised, plain in {
        "1d10t": "idiot", "id!ot": "idiot", "s.t.u.p.i.d": "stupid", "looooser": "loser", "m0r0n": "moron", "tr@sh": "trash",
        "p4th3t1c": "pathetic", "i d i o t": "idiot", "$tup1d": "stupid", "cl0wn!!": "clown", "st-upid": "stupid",
        "IDIOT,": "idiot", "2024": "2024", "plain": "plain", "a b": "a b", "": "",
    }.items():
        assert toxicity.restore_text(disguised, model) == plain
    # the best path is the best of all paths
    for _ in range(20):
        token = "".join(rng.choice("idot10!3") for _ in range(5))
        paths = [("", 0.0)]
        for options in toxicity.lattice(token):
            paths = [(t + s, c + k) for t, c in paths for s, k in options]

        def total(text, cost):
            a = b = 0
            s = -cost
            for c in text:
                z = toxicity.symbol(c)
                s += model[(a << 12) | (b << 6) | z]
                a, b = b, z
            return s + model[(a << 12) | (b << 6)]

        best = max(total(t, c) for t, c in paths)
        found = toxicity.decode(token, model)
        assert max(total(t, c) for t, c in paths if t == found) == pytest.approx(best)


def test_toxicity(spark, docs, clashing, empty, rows):
    rng = random.Random(3)
    bad = ["idiot", "moron", "scum"]
    texts = []
    for i in range(400):
        w = words(rng, 30)
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(bad)
            w[rng.randrange(30)] = rng.choice(bad)
        texts.append((" ".join(w), int(toxic)))
    d, labels = labelled(spark, texts, "toxic")
    got = toxicity.score_toxicity(d, labels).collect()
    assert all(r.predicted == texts[r.doc_id][1] for r in got if r.held_out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    hidden = spark.createDataFrame(
        [*enumerate(t for t, _ in texts), (1000, "w1 w2 m0r0n w3 and 1d10t"), (1001, "w1 w2 w3"), (1002, None), (1003, "")], "doc_id bigint, text string")
    seen = {r.doc_id: r.predicted for r in toxicity.score_toxicity(hidden, labels).collect()}
    assert [seen[i] for i in (1000, 1001, 1002, 1003)] == [1, 0, 0, 0]
    for df in (docs, clashing):
        assert toxicity.score_toxicity(df, labels).count() == len(rows)
        kept = toxicity.without_toxic(df, labels)
        assert kept.columns == df.columns
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert max(r.score for r in toxicity.score_toxicity(docs, none).collect()) < 1e-6
