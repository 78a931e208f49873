"""Approximate nearest neighbours by cross-polytope hashing (Andoni et al., 2015), with exact reranking.

Three rounds of random signs and a fast Hadamard transform stand for a random rotation. A unit vector's hash is the
signed axis nearest to it. Each of several tables uses a rotation of its own; a query probes the nearest axes of each,
and every vector found there is scored exactly.

An inner product depends on the norm too. Stored vectors are dealt into ranges of norms, each with buckets of its own: in
a range, where norms are alike, the directions decide. Every query probes every range. Ranges of few vectors are one
bucket, and queries that met few vectors in the others are scored against all.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.ordering import checkpointed

#: Measured recall of the 20 nearest on vectors without any clusters: 0.95 and more (see README).
TABLES, PROBES = 12, 14
#: Where buckets are small, more of them are probed, so that a query meets about so many vectors.
CANDIDATES = 4000
#: Ranges of norms for each factor of two. Neighbours with no more than CANDIDATES vectors together are one.
NORM_STEPS = 2
NEAREST, QUERY_STEP = 20, 20
BLOCK = 4096  # vectors of a bucket that are scored at once
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of x times the Hadamard matrix, in n log n steps; the number of columns is a power of two."""
    n, x, step = x.shape[1], x.copy(), 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = low + high, low - high
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    signs = np.random.default_rng([seed, table, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], x.shape[1]))
    return x


def signed_axes(y: np.ndarray, n: int) -> np.ndarray:
    """The n signed axes nearest to each row, nearest first, as twice the axis plus one if positive."""
    size = np.abs(y)
    n = min(n, y.shape[1])
    axes = np.argsort(-size, axis=1, kind="stable")[:, :n]
    return axes * 2 + (np.take_along_axis(y, axes, axis=1) > 0)


def padded(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose cosine orders pairs as the inner product of the originals does: stored vectors are divided by
    the longest and get a coordinate that fills them up, queries get a zero. Padded to a power of two."""
    n = 1 << int(x.shape[1]).bit_length()
    out = np.zeros((len(x), n))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    out[:, : x.shape[1]] = x / (length if query else longest)
    if not query:
        out[:, x.shape[1]] = np.sqrt(np.maximum(1 - np.square(length[:, 0] / longest), 0))
    return out


def usable(vector: Column) -> Column:
    """Neither null, empty, zero nor with a null or non-finite component."""
    fit = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fit & F.exists(vector, lambda x: x != 0)


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows in double precision; they are kept in the width of the table they come from."""
    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype("<f8")


def norm_ranges(sizes: dict[int, int], buckets: int, tables: int, probes: int) -> tuple[dict[int, int], list[int]]:
    """Each norm step's range, and how many buckets of each range a query probes in a table; 0 if the range is one bucket."""
    of, totals = {}, []
    for step in sorted(sizes, reverse=True):
        if not totals or totals[-1] + sizes[step] > CANDIDATES:
            totals.append(0)
        totals[-1] += sizes[step]
        of[step] = len(totals) - 1
    return of, [0 if n <= CANDIDATES else max(probes, math.ceil(CANDIDATES * buckets / (tables * n))) for n in totals]


def _hashes(plan: dict[int, tuple[dict[int, int], list[int], int]], tables: int, kind: str):
    """Rows of the buckets, stored vectors and queries. `plan` has for each length the ranges, their probes, and into how
    many parts the queries of ranges that are one bucket are dealt."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield from emit_part(batch.slice(start, 1000))

    def emit_part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, query, blobs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        classes, steps = ids.to_numpy(), batch.column(3).to_pylist()
        lengths = np.array([len(b) // np.dtype(kind).itemsize for b in blobs])

        def rows(d: int, table: int, ranges: np.ndarray, take: np.ndarray, codes: np.ndarray, stored: bool) -> Iterator[pa.RecordBatch]:
            if len(take):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((int(d) << 40) | (table << 24) | codes.astype(np.int64)), pa.array(ranges.astype(np.int32)),
                     pa.array(np.full(len(take), stored)), pa.array(np.full(len(take), bool(table))),
                     ids.take(pa.array(take)), pa.array([blobs[i] for i in take], pa.binary())],
                    names=["bucket", "range", "stored", "hashed", "class", "vector"])

        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            of, probes, parts = plan[int(d)]
            mine = np.array([of[steps[i]] for i in at])
            hashed, asking = np.array(probes)[mine] > 0, at[query[at]]
            whole = at[~hashed]
            yield from rows(
                d, 0, np.repeat(mine[~hashed], parts), np.repeat(whole, parts), np.tile(np.arange(parts), len(whole)), True)
            for r, n in enumerate(probes):
                if not n:
                    yield from rows(d, 0, np.full(len(asking), r), asking, classes[asking] % parts, False)
            if not any(probes):
                continue
            x = padded(_matrix([blobs[i] for i in at], kind), 1.0, True)
            for table in range(tables):
                y = rotated(x, table)
                yield from rows(d, table + 1, mine[hashed], at[hashed], signed_axes(y[hashed], 1)[:, 0], True)
                probed = signed_axes(y[query[at]], max(probes))
                for r, n in enumerate(probes):
                    codes = probed[:, :n]
                    yield from rows(
                        d, table + 1, np.full(codes.size, r), np.repeat(asking, codes.shape[1]), codes.reshape(-1), False)

    return emit


def _best(queries: list[int], scores: np.ndarray, ids: np.ndarray, n: int, hashed: bool) -> Iterator[pa.RecordBatch]:
    """For each query the n best of a block by score, ties to the smaller class. The first row counts the
    vectors of the block if they were met by hashing."""
    found, chosen, met = [], [], []
    for row, q in enumerate(queries):
        s = scores[row]
        near = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n]) if len(s) > n else np.arange(len(s))
        near = near[np.lexsort((ids[near], -s[near]))][:n]
        found.append(np.full(len(near), q))
        chosen.append((ids[near], s[near]))
        met.append((np.arange(len(near)) == 0) * (len(s) if hashed else 0))
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate([c[0] for c in chosen]), pa.int64()),
             pa.array(np.concatenate([c[1] for c in chosen]), pa.float64()),
             pa.array(np.concatenate(met), pa.int64())], names=["query", "class", "score", "met"])


def _rerank(n: int, kind: str):
    """Buckets come in order, their queries first. Queries and stored vectors of a bucket are scored block by block."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, by_hash, queries, vectors, stored, blobs = None, False, [], [], [], []

        def score() -> Iterator[pa.RecordBatch]:
            if queries and stored:
                y, ids = _matrix(blobs, kind), np.array(stored)
                for start in range(0, len(queries), 512):
                    scores = _matrix(vectors[start: start + 512], kind) @ y.T
                    yield from _best(queries[start: start + 512], scores, ids, n, by_hash)
            stored.clear()
            blobs.clear()

        for batch in batches:
            for key, part, is_stored, hashed, i, vector in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (key, part) != bucket:
                    yield from score()
                    bucket, by_hash = (key, part), hashed
                    queries.clear()
                    vectors.clear()
                if not is_stored:
                    queries.append(i)
                    vectors.append(vector)
                elif queries:
                    stored.append(i)
                    blobs.append(vector)
                    if len(stored) >= BLOCK:
                        yield from score()
        yield from score()

    return rerank


def _norm_step(v: np.ndarray) -> int:
    """Steps are rounded, so that norms of about one are not parted."""
    return int(np.floor(NORM_STEPS * np.log2(np.clip(np.linalg.norm(v), 1e-300, 1e300)) + 0.5))


def _to_bytes(kind: str):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, dtype=kind) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary()),
                 pa.array([_norm_step(v.astype("<f8")) for v in vectors], pa.int32())],
                names=["vec_id", "vector", "step"])

    return convert


def _exact(kind: str):
    """Scores of the final pairs, one by one, so that equal vectors score equally."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [float(np.dot(_matrix([a], kind)[0], _matrix([b], kind)[0]))
                      for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query", "class", "score"])

    return score


def nearest(
    embeddings: DataFrame, is_query: Column | None = None, nearest: int = NEAREST, tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """For each query row the `nearest` rows other than itself with the largest inner product, among those found.

    Rows (vec_id, embedding) whose vector is null, empty, zero or not finite take no part, nor do those with null ids.
    Vectors are compared with those of their own length only. Equal vectors form a class that is hashed once: no query
    needs more than its `nearest` + 1 smallest ids, so a vector that makes up a third of all rows costs as much as any.
    All rows are indexed, by range of norms. A query that met few of the hashed vectors is scored against all. A query with fewer candidates gets them all. Rows that share an id are single candidates; for a
    query, no row with its own id counts. Other columns are not read. An empty table gives no rows.
    """
    asks = F.col("vec_id") % QUERY_STEP == 0 if is_query is None else is_query
    kind = "<f4" if embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = checkpointed(rows.mapInArrow(_to_bytes(kind), "vec_id bigint, vector binary, step int").withColumn("query", asks))
    # The smallest ids of a class, queries and others apart, so that a class with a query keeps one.
    few = Window.partitionBy("vector", "query").orderBy("vec_id")
    kept = rows.select("vector", "query", "step", "vec_id").withColumn("_rank", F.row_number().over(few)).where(
        F.col("_rank") <= nearest + 1)
    classes = checkpointed(kept.groupBy("vector").agg(
        F.bool_or("query").alias("query"), F.first("step").alias("step"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, nearest + 1).alias("ids"),
    ).withColumn("class", F.monotonically_increasing_id()))
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes, asking = defaultdict(dict), Counter()
    for r in classes.groupBy(F.octet_length("vector").alias("d"), "step").agg(  # a row for each length and step
            F.count("*").alias("n"), F.count_if("query").alias("asking")).collect():
        d = r["d"] // np.dtype(kind).itemsize
        sizes[d][r["step"]] = r["n"]
        asking[d] += r["asking"]
    plan = {d: (*norm_ranges(of, 2 << d.bit_length(), tables, probes), max(1, math.ceil(asking[d] / BLOCK)))
            for d, of in sizes.items()}  # two signs for each axis
    columns = ["bucket", "range", "stored", "hashed", "class", "vector"]
    smallest = classes.select("class", F.get("ids", F.lit(0)).alias("smallest"))

    def scored(buckets: DataFrame) -> DataFrame:
        """The best classes of each query; the ids of `nearest` + 1 classes hold the answer. `met` is the query's count."""
        found = buckets.repartition(n, "bucket", "range").sortWithinPartitions("bucket", "range", "stored").mapInArrow(
            _rerank(nearest + 1, kind), "query bigint, class bigint, score double, met bigint")
        pairs = found.groupBy("query", "class").agg(F.max("score").alias("score"), F.sum("met").alias("met"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "smallest")
        return pairs.join(smallest, "class").withColumn("_rank", F.row_number().over(best)).withColumn(
            "met", F.sum("met").over(Window.partitionBy("query"))).where(F.col("_rank") <= nearest + 1).drop("smallest")

    ranked = scored(classes.select("class", "query", "vector", "step").mapInArrow(
        _hashes(plan, tables, kind),
        "bucket bigint, range int, stored boolean, hashed boolean, class bigint, vector binary"))
    in_buckets = [d * np.dtype(kind).itemsize for d, (_, probed, _) in plan.items() if any(probed)]
    if in_buckets:
        ranked = checkpointed(ranked)
        served = ranked.where((F.col("_rank") > nearest) & (F.col("met") >= CANDIDATES // 2)).select(F.col("query").alias("class"))
        hashed = classes.where(F.octet_length("vector").isin(in_buckets))
        lacking = checkpointed(hashed.where("query").select("class", "vector").join(served, "class", "left_anti"))
        n_lacking = lacking.count()
        if n_lacking:  # blocks of them meet all vectors of their length, part by part
            blocks, parts = math.ceil(n_lacking / BLOCK), math.ceil(hashed.count() / BLOCK)

            def met_in(rows: DataFrame, block: Column, part: Column, stored: bool) -> DataFrame:
                return rows.withColumn("block", block).withColumn("part", part).select(
                    (F.col("block") * parts + F.col("part")).alias("bucket"), F.octet_length("vector").alias("range"),
                    F.lit(stored).alias("stored"), F.lit(False).alias("hashed"), "class", "vector").select(columns)

            def dealt(k: int) -> Column:
                return F.pmod(F.xxhash64("class"), F.lit(k))

            def every(k: int) -> Column:
                return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))

            again = scored(met_in(hashed, every(blocks), dealt(parts), True).unionByName(
                met_in(lacking, dealt(blocks), every(parts), False)))
            ranked = ranked.join(lacking.select(F.col("class").alias("query")), "query", "left_anti").unionByName(again)
    ranked = ranked.drop("_rank", "met")
    vectors = classes.select(F.col("class").alias("query"), F.col("vector").alias("asking"))
    members = classes.select("class", "ids", "vector")
    exact = ranked.join(members.drop("ids"), "class").join(vectors, "query").select(
        "query", "class", "asking", "vector").mapInArrow(_exact(kind), "query bigint, class bigint, score double")
    candidates = exact.join(members.drop("vector"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = candidates.withColumn("place", F.row_number().over(first)).where(F.col("place") <= nearest + 1).groupBy(
        "query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    # Every query row takes the list of its class, without itself.
    queries = rows.where("query").select(F.col("vec_id").alias("query_id"), "vector").join(
        classes.where("query").select("vector", F.col("class").alias("query")), "vector").select("query_id", "query")
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, nearest)
    return queries.join(listed, "query").select("query_id", F.posexplode(others).alias("_at", "_row")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), "_row.vec_id", "_row.score")
