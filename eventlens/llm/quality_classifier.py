"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

After Wang and Manning (2012), with the dual coordinate descent of Hsieh et al. (2008).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import held_out, split_words, with_labels
from eventlens.operators.ordering import checkpointed

#: n-grams are hashed into this many indicators; all tables of the model have this fixed size.
BITS = 18
GRAMS = (1, 2, 3, 4)
#: At most so many labelled rows of each class fit the hinge-loss model; the ratios come from all of them.
SAMPLE_PER_CLASS = 2000
SMOOTHING, COST, EPOCHS, THRESHOLD = 1.0, 1.0, 20, 0.3


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Indicators:
    """Which n-grams a whole text has: of its UTF-8 bytes, and of the marks "same word as before", "line seen before"."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.marks = _bucket(np.arange(1 << 40, (1 << 40) + 4, dtype=np.uint64), bits)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint64)
        found = []
        gram = np.zeros(len(data), dtype=np.uint64)
        for n in GRAMS:
            if len(data) < n:
                break
            gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1:]
            found.append(_bucket(gram | np.uint64(n << 33), self.bits))
        words = split_words(text)
        same = [a == b for a, b in zip(words, words[1:])]
        lines = [line for line in text.split("\n") if line]
        marked = (any(same), any(a and b for a, b in zip(same, same[1:])),
                  any(a and b and c for a, b, c in zip(same, same[1:], same[2:])), len(set(lines)) < len(lines))
        found.append(self.marks[np.array(marked)])
        for part in found:
            self.seen[part] = True
        ids = np.flatnonzero(self.seen)
        self.seen[ids] = False
        return ids


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the indicators, with their ratios multiplied in
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratios[ids]).sum())) or 1.0
        margin = float(self.weights[ids].sum()) / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _count(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, counts, rows = Indicators(bits), np.zeros((2, 1 << bits), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label, indicators(text)] += 1
                rows[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["indicator", "bad", "good"])
        yield pa.RecordBatch.from_arrays(  # the rows themselves are counted under -1
            [pa.array([-1]), pa.array([rows[0]]), pa.array([rows[1]])], names=["indicator", "bad", "good"])

    return count


def log_count_ratios(train: DataFrame, bits: int = BITS) -> tuple[np.ndarray, tuple[int, int]]:
    """Ratios over all labelled rows and the number of rows of either class. Tasks add up before anything is shuffled;
    the driver gets at most 2 ** bits + 1 rows."""
    sums = train.mapInArrow(_count(bits), "indicator bigint, bad bigint, good bigint").groupBy("indicator").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    counts, rows = np.zeros((2, 1 << bits)), (0, 0)
    at, bad, good = (sums.column(c).to_numpy() for c in ("indicator", "bad", "good"))
    inside = at >= 0
    counts[0, at[inside]], counts[1, at[inside]] = bad[inside], good[inside]
    if (~inside).any():
        rows = (int(bad[~inside].sum()), int(good[~inside].sum()))
    smooth = counts + SMOOTHING
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum()), rows


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: np.ndarray, epochs: int):
    """Weights and bias that minimise the hinge loss; every row is the unit vector of its scaled indicators."""
    scale = [1 / (float(np.sqrt(np.square(ratios[r]).sum())) or 1.0) for r in rows]
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, s = rows[i], scale[i]
            gradient = y[i] * ((w[ids] * ratios[ids]).sum() * s + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # a unit vector and the bias: squared norm 2
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[ids] += step * s * ratios[ids]
                bias += step
    return w * ratios, bias


def _calibrate(margins: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins; rows count as their class does in all labels."""
    weight = np.where(y > 0, share / max((y > 0).mean(), 1e-9), (1 - share) / max((y < 0).mean(), 1e-9))
    n_good, n_bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _fit(ratios: np.ndarray, share: float, bits: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, rows, labels = Indicators(bits), [], []
        for batch in batches:
            rows += [indicators(t).astype(np.int32) for t in batch.column(0).to_pylist()]
            labels += batch.column(1).to_pylist()
        y = np.where(np.array(labels, dtype=int) > 0, 1.0, -1.0)
        if len(set(labels)) < 2:  # nothing to tell apart: every score is the share of good labels
            weights, bias, slope, offset = np.zeros(1 << bits), 0.0, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        else:
            cost = COST * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
            weights, bias = dual_coordinate_descent(rows, y, ratios, cost, EPOCHS)
            norms = [float(np.sqrt(np.square(ratios[r]).sum())) or 1.0 for r in rows]
            margins = np.array([weights[r].sum() / n + bias for r, n in zip(rows, norms)])
            slope, offset = _calibrate(margins, y, share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([float(bias)]), pa.array([slope]), pa.array([offset])],
            names=["weights", "bias", "slope", "offset"])

    return fit


def train(labelled: DataFrame, bits: int = BITS, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Model from rows (doc_id, text, label 0 or 1). One task fits it on at most 2 * per_class rows, those whose ids come
    first in hash order; all rows count for the ratios."""
    ratios, (bad, good) = log_count_ratios(labelled.select("text", "label"), bits)
    share = good / (bad + good) if bad + good else 0.5
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "label").distinct().withColumn("_rank", F.row_number().over(first)).where(
        F.col("_rank") <= per_class).select("doc_id", "label")
    sample = labelled.join(F.broadcast(ids), ["doc_id", "label"]).select("text", "label")  # a bounded number of ids
    if not bad + good:
        return Model(np.zeros(1 << bits), ratios, 0.0, 1.0, 0.0)
    fitted = sample.orderBy(F.xxhash64("text"), "label").limit(2 * per_class).coalesce(1).mapInArrow(
        _fit(ratios, share, bits), "weights binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(bytes(fitted.weights), "<f8"), ratios, fitted.bias, fitted.slope, fitted.offset)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with the probability that its text is good.

    Learns from rows of `labels` (doc_id, quality) with label 0 or 1 whose id is not held out. Only the text is scored:
    equal texts have equal scores, null and empty ones that of a text without n-grams. If a label or an id repeats, each
    pair counts. Without labels of both classes every score is the share of good labels (0.5 without any). Other columns
    are not read. Null ids are scored and count as held out.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    model = train(checkpointed(with_labels(texts, marked)))  # read twice: for the ratios and for the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            scores = [model.score(indicators(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
