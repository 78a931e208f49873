"""Noisy-channel deobfuscation: restore disguised words under a character language model, then score the restored text.

A writer's word passes a channel that swaps letters for look-alikes, stretches or spaces them out. For every suspicious
token a lattice holds what each of its characters may have been; Viterbi decoding finds the most probable word under a
character trigram model of the whole corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import held_out, slices, split_words, with_labels
from eventlens.operators.ordering import checkpointed

#: Letters that characters may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "§": "s",
    "*": "aeiou",
}
#: Characters that may separate the letters of one word; a look-alike seldom stands for nothing.
SEPARATORS = "._-~'`^#%&=/\\,:;"
#: Costs in nats. Leaving out a look-alike must cost more than any letter does under the language model, or the
#: shorter word would often win.
SWAP, SEPARATE, DROP, SHORTEN = 0.5, 0.2, 15.0, 0.5

SYMBOLS = 64  # 0 boundary, 1 to 26 letters, 27 to 62 other letters by code point, 63 anything else
FEATURE_BITS, MIN_SUPPORT, PREFIXES, EVIDENCE, THRESHOLD = 22, 3, (4, 5, 6), 2, 0.5
CHANCE = 0.5
STEP, STEPS = 0.1, 400  # strengths of texts are counted in steps to fit the final curve
CACHE_WORDS = 200_000  # words that one task remembers; it starts afresh beyond


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 36 if c.isalpha() else 63


def _symbol_table() -> np.ndarray:
    table = np.array([symbol(chr(i)) for i in range(1 << 16)], dtype=np.int64)
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


# --- character language model ------------------------------------------------------------------------------------


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = _symbol_table(), np.zeros(SYMBOLS**3, dtype=np.int64)
    for (texts,) in slices(batches, 0):
        # a word starts after two boundaries
        spaced = f"  {'  '.join(w for text in texts for w in split_words((text or '').lower()))}  "
        points = np.frombuffer(spaced.encode("utf-32-le", "replace"), dtype=np.uint32)
        s = table[np.minimum(points, 0xFFFF)]
        grams = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
        counts += np.bincount(grams, minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) for all symbols, from the whole texts of all rows. At most 64 ** 3 sums reach the driver."""
    sums = docs.select("text").mapInArrow(_count_trigrams, "gram bigint, n bigint").groupBy("gram").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi = tri.sum(axis=0)
    one = bi.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (bi + 50 * p1) / (bi.sum(axis=1, keepdims=True) + 50)
    p3 = (tri + 50 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 50)
    return np.log(p3).astype(np.float32).reshape(-1)


# --- channel -----------------------------------------------------------------------------------------------------

_STRETCHED = re.compile(r"(.)\1\1", re.S)
_OUTER = "\"'()[]{}<>.,;:?¿¡!«»“”‘’…*#%&~`^=/\\-_"


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, the strings it may have been and what each costs."""
    steps = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run.group(1), len(run.group())
        if c.isalpha():
            options = {c * n: 0.0} if n < 3 else {c: 0.0, c * 2: 0.0}
            if n == 2:
                options[c] = SHORTEN
        else:
            options = {"": SEPARATE if c in SEPARATORS or c not in LOOKALIKES else DROP}
            for letter in LOOKALIKES.get(c, ""):
                options[letter] = min(SWAP, options.get(letter, SWAP))
                if n > 1:
                    options[letter * 2] = SWAP
        steps.append(list(options.items()))
    return steps


def decode(token: str, model: list[float]) -> str:
    """The most probable word behind a token: best path by model and channel cost, over states of the last two symbols."""
    beams: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in beams.items():
            for string, cost in options:
                x, y, s = a, b, score - cost
                for c in string:
                    z = symbol(c)
                    s += model[(x << 12) | (y << 6) | z]
                    x, y = y, z
                best = following.get((x, y))
                if best is None or (s, text + string) > best:
                    following[(x, y)] = (s, text + string)
        beams = following
    # the end of the word counts too
    return max((score + model[(a << 12) | (b << 6)], text) for (a, b), (score, text) in beams.items())[1]


def restore_token(token: str, model: list[float]) -> str:
    """A lower-case token as written by its author before any disguise. Tokens of letters alone stay as they are."""
    core = token.strip(_OUTER) if not token.isalpha() else token
    if not core:
        return ""
    if core.isalpha():
        return decode(core, model) if _STRETCHED.search(core) else core
    if not any(c.isalpha() for c in core):
        return core
    return decode(token.lstrip(_OUTER.replace("!", "")).rstrip(_OUTER), model)  # a leading '!' may be a letter


def joined_words(words: list[str]) -> list[str]:
    """Words with every run of three or more single characters, at least two of them letters, put together."""
    if not any(len(a) == 1 and len(b) == 1 for a, b in zip(words, words[1:])):
        return words
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w not in _OUTER:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 3 and sum(c.isalpha() for c in run) >= 2 else run
        run = []
        if w:
            out.append(w)
    return out


def restore_text(text: str | None, model: list[float]) -> str:
    return " ".join(filter(None, (restore_token(w, model) for w in joined_words(split_words((text or "").lower())))))


# --- scoring -----------------------------------------------------------------------------------------------------


def _features(word: str) -> tuple[int, ...]:
    """Hashes of a restored word and of its beginnings, as stems show in inflected forms."""
    mask = (1 << FEATURE_BITS) - 1
    if not word:
        return ()
    return (zlib.crc32(word.encode("utf-8", "replace")) & mask,) + tuple(
        zlib.crc32(f"{word[:n]}*".encode("utf-8", "replace")) & mask for n in PREFIXES if len(word) > n)


class Restorer:
    """Distinct tokens of a text to values made from their restored form; remembers a bounded number of them."""

    def __init__(self, model: np.ndarray, value):
        self.model, self.value, self.known = model.tolist(), value, {}

    def __call__(self, text: str | None) -> list:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        out, known = [], self.known
        for token in set(joined_words(split_words((text or "").lower()))):
            found = known.get(token)
            if found is None:
                found = known[token] = self.value(restore_token(token, self.model))
            out.append(found)
        return out


def _count_features(model: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = Restorer(model, _features)
        counts, rows = np.zeros((2, 1 << FEATURE_BITS), dtype=np.int32), [0, 0]
        for part in slices(batches, 0, 1):
            for text, label in zip(*part):
                ids = np.fromiter({f for features in restored(text) for f in features}, dtype=np.int64)
                counts[label, ids] += 1
                rows[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        for start in range(0, len(used), 100_000):
            part = used[start: start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[0, part].astype(np.int64)), pa.array(counts[1, part].astype(np.int64))],
                names=["feature", "clean", "toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(rows[:1]), pa.array(rows[1:])], names=["feature", "clean", "toxic"])

    return count


def _information(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)


def evidence(labelled: DataFrame, model: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's share of toxic and of clean rows where it speaks for toxic, else 0.

    All labelled rows count. A feature speaks only if texts with it are toxic more often than not, and if its likelihood
    ratio test, at CHANCE shared among all features tried, rules out chance: any text has some words that lean one way. The table has 2 ** FEATURE_BITS entries at any
    size of the corpus; only features found in MIN_SUPPORT toxic rows are brought to the driver."""
    sums = labelled.select("text", "label").mapInArrow(
        _count_features(model), "feature bigint, clean bigint, toxic bigint"
    ).groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = sums.where((F.col("toxic") >= MIN_SUPPORT) | (F.col("feature") < 0)).toArrow()
    at, clean, toxic = (found.column(c).to_numpy() for c in ("feature", "clean", "toxic"))
    rows = at < 0
    n_clean, n_toxic = int(clean[rows].sum()), int(toxic[rows].sum())
    at, clean, toxic = at[~rows], clean[~rows].astype(float), toxic[~rows].astype(float)
    with_it = (toxic + clean) / max(n_toxic + n_clean, 1)
    gain = 2 * (_information(toxic, n_toxic * with_it) + _information(clean, n_clean * with_it)
                + _information(n_toxic - toxic, n_toxic * (1 - with_it)) + _information(n_clean - clean, n_clean * (1 - with_it)))
    leaning = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    ratios = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
    more_often_than_not = max(0.0, float(np.log((n_clean + 0.5) / (n_toxic + 0.5))))
    ratios[at] = np.where((leaning > more_often_than_not) & (gain > 2 * np.log(max(len(at), 1) / CHANCE)), leaning, 0)
    return ratios


def _strength(values: list[float]) -> float:
    return sum(sorted(values)[-EVIDENCE:])


def _word_values(ratios: np.ndarray):
    return lambda word: max((float(ratios[f]) for f in _features(word)), default=0.0)


def _count_strengths(model: np.ndarray, ratios: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, counts = Restorer(model, _word_values(ratios)), np.zeros((STEPS, 2), dtype=np.int64)
        for part in slices(batches, 0, 1):
            for text, label in zip(*part):
                counts[min(int(_strength(restored(text)) / STEP), STEPS - 1), label] += 1
        used = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used, 0]), pa.array(counts[used, 1])], names=["step", "clean", "toxic"])

    return count


def calibration(labelled: DataFrame, model: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of toxic over strength, from all labelled rows, counted in STEPS steps."""
    sums = labelled.select("text", "label").mapInArrow(
        _count_strengths(model, ratios), "step bigint, clean bigint, toxic bigint"
    ).groupBy("step").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, clean, toxic = (sums.column(c).to_numpy().astype(float) for c in ("step", "clean", "toxic"))
    x, n_clean, n_toxic = (at + 0.5) * STEP, clean.sum(), toxic.sum()
    if not n_clean or not n_toxic:
        share = n_toxic / max(n_toxic + n_clean, 1)
        return 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    y1, y0 = (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2)
    a, b = 1.0, float(np.log(n_toxic / n_clean))
    for _ in range(200):  # Newton's method, in short steps as the classes may be parted clearly
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = toxic * (p - y1) + clean * (p - y0), (toxic + clean) * p * (1 - p) + 1e-9
        gradient = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        a, b = a - float(move[0]), b - float(move[1])
        if np.abs(move).max() < 1e-6:
            break
    return max(a, 0.0), b


def with_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """All columns of `docs` and, as `name`, the probability that the text is toxic.

    The language model counts the whole texts of all rows; the words that speak for toxic, and how much their two
    strongest in a text mean, are learned from the rows of `labels` (doc_id, toxic) with 0 or 1 whose id is not held out.
    Two words at most count, so that long texts are judged like short ones. Equal texts have equal scores. Null and empty
    texts score as texts without such words; without labels of both classes, all texts score the share of toxic rows (0 without any).
    Repeated labels or ids count once for each pair. Null ids are scored and count as held out. Of the other columns none
    is read; one called `name` is replaced.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("toxic").cast("int").alias("label"))
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    labelled = checkpointed(with_labels(texts, marked).select("text", "label"))  # read twice
    model = language_model(docs)
    ratios = evidence(labelled, model)
    slope, offset = calibration(labelled, model, ratios)
    rows = docs.drop(name)
    text_at = rows.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = Restorer(model, _word_values(ratios))
        for batch in batches:
            totals = np.array([_strength(restored(text)) for (part,) in slices([batch], text_at) for text in part], dtype=float)
            scores = 1 / (1 + np.exp(-np.clip(slope * totals + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's id, whether it is held out, its score and the verdict; see `with_toxicity`."""
    scored = with_toxicity(docs.select("doc_id", "text"), labels, "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not judged toxic, with all their columns."""
    name = "_toxicity"
    while name in docs.columns:
        name = f"_{name}"
    return with_toxicity(docs, labels, name).where(F.col(name) < threshold).drop(name)
