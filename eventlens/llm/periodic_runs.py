"""Periodic runs of words: maximal stretches that repeat with some smallest period, found through suffix trees.

Every run has a Lyndon root (Bannai et al., 2017): its words in smallest rotation, and for one of the two orders of the
words that root is the longest Lyndon word where it starts. So each position gives a candidate period for either order,
and the longest common extensions (LCE) to the right and to the left show how far that period reaches. Extensions are
answered in constant time from Ukkonen trees of the words and of their reversal, as the lowest common ancestor of two
leaves on the trees' Euler tours.

Trees are built for all words that can be part of a run. In a run of at least `3 * period` and 24 words, each eight words
in a row occur once more in the same run, so stretches without such repeats hold none (`stretches`).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import split_words, words
from eventlens.llm.rolling import run_hashes, word_hashes

MIN_LENGTH, MIN_REPEATS = 24, 3
ROWS_AT_ONCE = 128
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


# --- suffix tree -------------------------------------------------------------------------------------------------


def suffix_tree(s: list[int], symbols: int) -> tuple[dict[int, int], list[int]]:
    """Ukkonen's tree of `s`, whose last symbol occurs nowhere else: edges and the string depths of inner nodes.

    Leaves are numbered by where their suffix starts, inner nodes from len(s) on, the root first. Edges lead from
    node * symbols + first symbol to a node.
    """
    n = len(s)
    edges: dict[int, int] = {}
    begin, end = [0] * n + [0], [n] * n + [0]  # the words on the edge into a node
    link, depth = [n], [0]  # of inner nodes
    root = node = n
    edge = length = waiting = leaf = 0
    for i in range(n):
        c = s[i]
        waiting += 1
        unlinked = -1
        while waiting:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = leaf
                begin[leaf] = i
                leaf += 1
                if unlinked >= 0:
                    link[unlinked - n] = node
                    unlinked = -1
            else:
                first = begin[child]
                span = (end[child] if child >= n else i + 1) - first
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[first + length] == c:
                    length += 1
                    if unlinked >= 0:
                        link[unlinked - n] = node
                    break
                inner = len(begin)
                begin.append(first)
                end.append(first + length)
                link.append(root)
                depth.append(waiting - 1)
                edges[key] = inner
                begin[child] = first + length
                edges[inner * symbols + s[first + length]] = child
                edges[inner * symbols + c] = leaf
                begin[leaf] = i
                leaf += 1
                if unlinked >= 0:
                    link[unlinked - n] = inner
                unlinked = inner
            waiting -= 1
            if node == root:
                if length:
                    length -= 1
                    edge = i - waiting + 1
            else:
                node = link[node - n]
    return edges, depth


class Extensions:
    """Longest common extensions of any two suffixes of `s`, in constant time each.

    The Euler tour of the tree visits its leaves in the order of their suffixes. Between two leaves, the shallowest node
    of the tour is their lowest common ancestor, and its depth the length of what they share. The tour is kept as the
    shallowest depth between neighbouring leaves, with the minima of all stretches of 2 ** k of them.
    """

    def __init__(self, s: list[int], symbols: int):
        n = len(s)
        edges, depth = suffix_tree(s, symbols)
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        nodes = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        del edges
        by_key = np.argsort(keys)
        children = nodes[by_key].tolist()
        offsets = np.searchsorted(keys[by_key] // symbols, np.arange(n, n + len(depth) + 1)).tolist()
        leaves, shared = [], []
        stack = [(n, 0)]
        while stack:
            node, above = stack.pop()
            if node < n:
                leaves.append(node)
                shared.append(above)
                continue
            first, last, own = offsets[node - n], offsets[node - n + 1] - 1, depth[node - n]
            while last > first:
                stack.append((children[last], own))
                last -= 1
            stack.append((children[first], above))
        self.order = np.array(leaves, dtype=np.int64)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[self.order] = np.arange(n)
        self.least = [np.array(shared, dtype=np.int32)]
        while (1 << len(self.least)) <= n:
            step, below = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(below[:-step], below[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different positions, how many symbols the suffixes from there share."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        found = np.zeros(len(a), dtype=np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.least[k]
            found[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return found


# --- runs --------------------------------------------------------------------------------------------------------


def next_above(rank: list[int]) -> list[int]:
    """For each position the next one of a higher rank; the length where there is none."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] < r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(ids: list[int], min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a list of numbers from 1 on, by start, then period."""
    n, symbols = len(ids), max(ids) + 1
    forward = Extensions([*ids, 0], symbols)
    at = np.arange(n)
    # 0 ends the words and is the smallest symbol. The next smaller suffix ends the longest Lyndon word of the one
    # order, the next larger that of the other.
    smaller = np.array(next_above((n - forward.rank).tolist())[:n])
    larger = np.array(next_above(forward.rank.tolist())[:n])
    starts, ends = np.concatenate([at, at]), np.concatenate([smaller, larger])
    inside = ends < n
    starts, ends = starts[inside], ends[inside]
    period = ends - starts
    right = forward(starts, ends)
    del forward
    # The first root of a run starts within its first period, so that less than a period lies to the left of it.
    # Candidates that can't be long enough even then go before the second tree.
    wide = np.flatnonzero(2 * period + right > np.maximum(min_length, min_repeats * period))
    if not len(wide):
        return []
    starts, ends, period, right = starts[wide], ends[wide], period[wide], right[wide]
    backward = Extensions([*reversed(ids), 0], symbols)
    left = backward(n - starts, n - ends)
    length = left + period + right
    found = np.flatnonzero(length >= np.maximum(min_length, min_repeats * period))
    return sorted(set(zip((starts - left)[found].tolist(), length[found].tolist(), period[found].tolist())),
                  key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int]]:
    """Parts (from, to) of a text that hold all of its runs, each run whole and in one part.

    With g = min_length // 3, all g words in a row that lie in a run occur once more in it, a period earlier or later:
    for a period p, 2 * p + g - 1 <= max(min_length, min_repeats * p) <= length. So a run is part of a stretch of
    places where such groups repeat, and of one where they repeat within the stretch. Different groups with one hash
    only make a stretch longer.
    """
    g = min_length // 3
    todo, done = [(0, len(hashes))], []
    while todo:
        start, end = todo.pop()
        if end - start < min_length:
            continue
        grams = run_hashes(hashes[start:end], g)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        repeated = np.zeros(len(grams) + 2, dtype=bool)
        repeated[1 + order[1:][same]] = True
        repeated[1 + order[:-1][same]] = True
        edges = np.flatnonzero(repeated[1:] != repeated[:-1])
        if len(edges) == 2 and edges[0] == 0 and edges[1] == len(grams):
            done.append((start, end))
            continue
        todo += [(start + a, start + b + g - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return sorted(done)


def text_runs(text: str | None, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> tuple[list, str]:
    """Runs of a text, and its words without those that some run repeats, joined by one space."""
    tokens = split_words(text)
    if len(tokens) < min_length:
        return [], " ".join(tokens)
    found = []
    for start, end in stretches(word_hashes(text), min_length, min_repeats):
        numbers: dict[str, int] = {}
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in tokens[start:end]]
        found += [(start + s, length, period) for s, length, period in runs_of(ids, min_length, min_repeats)]
    if found:
        change = np.zeros(len(tokens) + 1, dtype=np.int64)
        for start, length, period in found:
            change[start + period] += 1
            change[start + length] -= 1
        tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return found, " ".join(tokens)


def _find(min_length: int, min_repeats: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = [text_runs(t, min_length, min_repeats) for t in part.column(1).to_pylist()]
                best = [max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None for runs, _ in found]
                as_rows = lambda runs: [dict(zip(("start", "length", "period"), r)) for r in runs]
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([as_rows(runs) for runs, _ in found], pa.list_(run)),
                    pa.array([None if b is None else as_rows([b])[0] for b in best], run),
                    pa.array([collapsed for _, collapsed in found], pa.string()),
                ], names=["doc_id", "runs", "best", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Per document its `runs` by start, then period, the one of the greatest length / period (`best`; ties: smallest
    start, then period; null without runs) and the `collapsed` text: its words without those that a run holds after its
    first period, joined by one space.

    A run is a stretch of words with smallest period q and at least max(min_length, min_repeats * q) words that can't be
    made longer. Null, empty and blank texts have no words and no runs. Each row is worked on alone: ids may be null or
    repeat. Columns other than doc_id and text are not read. An empty table gives no rows. A task holds one text at a
    time with the trees of one of its stretches, some 1 KB a word.
    """
    if min_repeats < 3 or min_length < 6:
        raise ValueError("runs repeat three times or more, and have six words or more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = RUNS.removeprefix("array<").removesuffix(">")
    return docs.select("doc_id", "text").mapInArrow(
        _find(min_length, min_repeats), f"doc_id {kind}, runs {RUNS}, best {run}, collapsed string")


# --- texts with a periodic end -----------------------------------------------------------------------------------


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, text), where one id in ten has a text that goes on periodically from some word on.

    With h = crc32 of the id as text and g = h div 10, for h % 10 = 0 the words i >= a become the words
    a + (i - a) % p, for a = g % n and p = 1 + (n - a) div (3 + g % 8). Rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        periodic = lambda start, period: F.concat_ws(" ", F.transform(
            w, lambda x, i: F.when(i < start, x).otherwise(F.get(w, (start + (i - start) % period).cast("int")))))
        # a transform over one element holds a value, so that it is not computed for each word
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda v: periodic(v.a, v.p))[0]

    split = words(F.col("text"))
    ends = F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, edited(w)))[0]
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return docs.select("doc_id", F.when(chosen, ends).otherwise(F.col("text")).alias("text"))
