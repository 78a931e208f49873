"""Whitening of embeddings with components from the exact characteristic polynomial of their integer scatter.

Vectors become integers, so that their scatter is an integer matrix known without rounding. Its characteristic polynomial
is computed modulo many primes (Hessenberg reduction, one prime after the other as rows of a Spark job) and put together
by Chinese remaindering. All roots of a symmetric matrix' polynomial are real; for such polynomials, Descartes' rule of
signs counts the roots above a point exactly. So bisection isolates each root to any precision, and inverse iteration with
that root gives its component: the null space of the matrix less the root.

The table is read for the sums, shuffled once to leave out equal vectors, and read for the result. What the driver holds
depends on the number of dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.ordering import checkpointed

#: Long x = floor(SCALE * c) + SHIFT of an entry c.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
ROOT_BITS = 192  # of each root, relative to it
LIMB = 32  # sums travel in pieces of so many bits
_LARGEST = 1 << 62  # entries beyond count as this, with their sign


# --- exact sums --------------------------------------------------------------------------------------------------


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x.T @ x of int64 rows, as Python integers.

    Floating-point products are exact below 2 ** 53, so entries are split into pieces and rows into blocks for which all
    sums stay below.
    """
    d = x.shape[1]
    total = np.zeros((d, d), dtype=object)
    if not x.size:
        return total
    bits = max(int(abs(int(x.max()))), int(abs(int(x.min())))).bit_length()
    width = bits if bits <= 20 else 20
    parts = [x] if bits <= 20 else [
        (x >> (20 * k)) & ((1 << 20) - 1) if 20 * (k + 1) < bits + 1 else x >> (20 * k) for k in range(-(-(bits + 1) // 20))]
    rows = 1 << max(53 - 2 * (width + 1), 1)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            for at in range(0, len(x), rows):
                product = a[at: at + rows].astype(np.float64).T @ b[at: at + rows].astype(np.float64)
                total += product.astype(np.int64).astype(object) << (20 * (i + j))
    return total


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1


def _add_up(d: int):
    """Sums of a task's vectors: their number (row -1), entries (row d) and products of entries, in limbs."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            # halves, so that no sum of a batch passes 64 bits
            sums += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            products += exact_gram(x)
        cells = [(-1, 0, n), *((d, j, v) for j, v in enumerate(sums))]
        cells += [(i, j, products[i, j]) for i in range(d) for j in range(i + 1)]
        rows = [(i, j, place, limb) for i, j, v in cells for place, limb in _limbs(int(v))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["i", "j", "place", "limb"])

    return add_up


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


# --- characteristic polynomial -----------------------------------------------------------------------------------


def primes_below(limit: int, count: int) -> list[int]:
    """The largest `count` primes below `limit` (Miller-Rabin, exact for numbers of this size)."""

    def prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True

    found, n = [], limit - 1 - limit % 2
    while len(found) < count:
        if prime(n):
            found.append(n)
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first, monic) of the characteristic polynomial modulo a prime below 2 ** 31."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1] % p) % p
        moved = np.zeros(d, dtype=np.int64)
        for part in range(0, len(factors), 2):  # two products below 2 ** 62 add up without overflow
            moved = (moved + (h[:, k + 2 + part: k + 4 + part] * factors[part: part + 2]).sum(axis=1)) % p
        h[:, k + 1] = (h[:, k + 1] + moved) % p
    # polynomials of the leading blocks, each from the ones before
    blocks = np.zeros((d + 1, d + 1), dtype=np.int64)
    blocks[0, 0] = 1
    for k in range(1, d + 1):
        row = np.roll(blocks[k - 1], 1)
        row = (row - h[k - 1, k - 1] * blocks[k - 1] % p) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            row = (row - int(h[i - 1, k - 1]) * product % p * blocks[i - 1] % p) % p
        blocks[k] = row
    return blocks[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Elementary symmetric functions e_0 = 1, e_1, ... of the roots of a positive semidefinite integer matrix: up to their
    signs the coefficients of its characteristic polynomial, exactly. One row of a Spark job for each prime."""
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    # Maclaurin: e_k is at most its value for d equal roots
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 1)
    cells = [[int(v) for v in row] for row in matrix]

    def reduce_modulo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(cells, dtype=object).reshape(d, d)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([polynomial_modulo(whole, p).tolist()], pa.list_(pa.int64()))],
                    names=["p", "coefficients"])

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 4 * d)).mapInArrow(
        reduce_modulo, "p bigint, coefficients array<bigint>").collect()
    modulus = reduce(lambda a, b: a * b, (r.p for r in rows), 1)
    weights = [(modulus // r.p) * pow(modulus // r.p, -1, r.p) for r in rows]
    return [(-1) ** k * sum(w * r.coefficients[d - k] for w, r in zip(weights, rows)) % modulus for k in range(d + 1)]


# --- roots -------------------------------------------------------------------------------------------------------


def roots_above(e: list[int], point: int) -> int:
    """How many roots (with multiplicity) are above a point: the changes of sign of the polynomial moved there, as all
    its roots are real."""
    c = [(-1) ** k * v for k, v in enumerate(e)]  # leading coefficient first
    d = len(c) - 1
    for last in range(d, 0, -1):
        for i in range(1, last + 1):
            c[i] += point * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate_root(e: list[int], index: int, bits: int = ROOT_BITS) -> tuple[int, int, int, int]:
    """The `index`-th largest root (from 0) of a polynomial with positive roots: (numerator, shift, first, count).

    The root lies within one of numerator / 2 ** shift, to the given number of bits. Roots that this precision does not
    part count as one: the `count` ones from `first` on.
    """
    shift, low, high = 0, 0, 2 * e[1] + 1  # roots above low: more than index; above high: at most index
    above_low, above_high = len(e) - 1, 0
    scaled = e
    while True:
        if high - low <= 1:
            if low.bit_length() >= bits:
                return low, shift, above_high, above_low - above_high
            # finer steps: the roots of the scaled polynomial are 2 ** 16 times as large
            shift, low, high = shift + 16, low << 16, high << 16
            scaled = [v << (shift * k) for k, v in enumerate(e)]
        middle = (low + high) >> 1
        if above_low - above_high == 1:
            # a simple root: the sign changes once between the ends, negative below the root if an even number is above
            value = reduce(lambda total, v: total * middle + v, ((-1) ** k * v for k, v in enumerate(scaled)))
            found = above_low if (value < 0 if above_high % 2 == 0 else value > 0) else above_high
        else:
            found = roots_above(scaled, middle)
        if found > index:
            low, above_low = middle, found
        else:
            high, above_high = middle, found


def null_vectors(matrix: np.ndarray, numerator: int, shift: int, count: int) -> np.ndarray:
    """Unit vectors (count x d) that the matrix less numerator / 2 ** shift takes to nearly zero: inverse iteration in
    fixed-point numbers of as many bits as the root has and 64 more, orthogonal to each other."""
    d = len(matrix)
    point = numerator.bit_length() + 64
    one = 1 << point
    a = np.array([[int(v) << shift for v in row] for row in matrix], dtype=object).reshape(d, d)
    for i in range(d):
        a[i, i] -= numerator
    norm = max(1, max(abs(int(v)) for v in a.ravel()))
    a = np.array([(int(v) << point) // norm for v in a.ravel()], dtype=object).reshape(d, d)
    swaps, factors = [], []
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        swaps.append(pivot)
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        f = np.array([(int(v) << point) // int(a[k, k]) for v in a[k + 1:, k]], dtype=object)
        factors.append(f)
        if len(f):
            a[k + 1:, k:] -= (f[:, None] * a[k, k:]) >> point
    start = np.random.default_rng(12).integers(-(1 << 30), 1 << 30, size=(count, d))
    vectors = [np.array([int(v) << (point - 30) for v in row], dtype=object) for row in start]
    for _ in range(3):
        for c, v in enumerate(vectors):
            v = v.copy()
            for k in range(d):
                v[k], v[swaps[k]] = v[swaps[k]], v[k]
                if k + 1 < d:
                    v[k + 1:] -= (factors[k] * v[k]) >> point
            for k in range(d - 1, -1, -1):
                v[k] = ((int(v[k]) - int((a[k, k + 1:] * v[k + 1:]).sum() >> point if k + 1 < d else 0)) << point) // int(a[k, k])
            largest = max(1, max(abs(int(x)) for x in v))
            v = np.array([(int(x) << point) // largest for x in v], dtype=object)
            for u in vectors[:c]:
                v = v - ((u * (int((u * v).sum()) >> point)) >> point)
            length = max(1, isqrt(int((v * v).sum())))
            vectors[c] = np.array([(int(x) << point) // length for x in v], dtype=object)
    return np.array([[float(int(x) / one) for x in v] for v in vectors])


@dataclass(frozen=True)
class Components:
    """What the fit gives: number and sums of the fitted vectors, and per component its eigenvalue and unit vector."""

    n: int
    sums: tuple[int, ...]
    explained: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def components_of(spark: SparkSession, matrix: np.ndarray, n: int, sums: list[int], k: int) -> Components:
    """Components of the covariance matrix / n ** 2, numbered by falling eigenvalue; those of eigenvalue 0 are left out.
    One row of a Spark job for each component."""
    d = len(matrix)
    e = characteristic_polynomial(spark, matrix) if d and n else [1]
    while len(e) > 1 and not e[-1]:  # each zero at the end is a root 0
        e.pop()
    k = min(k, len(e) - 1)
    if not k:
        return Components(n, tuple(sums), np.zeros(0), np.zeros(0), np.zeros((0, d)))
    cells = [[int(v) for v in row] for row in matrix]
    digits = [hex(v) for v in e]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, coefficients = np.array(cells, dtype=object).reshape(d, d), [int(v, 16) for v in digits]
        for batch in batches:
            for index in batch.column(0).to_pylist():
                numerator, shift, first, count = isolate_root(coefficients, index)
                vector = null_vectors(whole, numerator, shift, count)[index - first]
                # of the matrix; the covariance has 1 / n ** 2 of it
                value, share = numerator / ((n * n) << shift), numerator / (coefficients[1] << shift)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([index], pa.int64()), pa.array([value]), pa.array([share]), pa.array([vector.tolist()], pa.list_(pa.float64()))],
                    names=["i", "value", "share", "vector"])

    rows = spark.createDataFrame([(i,) for i in range(k)], "i bigint").repartition(k).mapInArrow(
        solve, "i bigint, value double, share double, vector array<double>").collect()
    rows.sort(key=lambda r: r.i)
    return Components(n, tuple(sums), np.array([r.share for r in rows]), np.array([r.value for r in rows]), np.array([r.vector for r in rows]))


# --- the table ---------------------------------------------------------------------------------------------------


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part: x holds floor(SCALE * c) of each entry, that is, without SHIFT."""
    scaled = F.transform("embedding", lambda c: F.least(F.greatest(
        F.floor(c.cast("double") * SCALE).cast("decimal(38,0)"), F.lit(-_LARGEST)), F.lit(_LARGEST)).cast("bigint"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: finite(c.cast("double")))).select(
        "vec_id", scaled.alias("x"))


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(s) for s in sums), default=0)
    if largest < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _projected(centred: np.ndarray, fit: Components) -> np.ndarray:
    return (centred / fit.n).astype(np.float64) @ fit.vectors.T / np.sqrt(fit.values)


def fit_components(vectors: DataFrame, d: int, k: int) -> tuple[Components, float]:
    """Components from each distinct vector (x) once, and the largest error of the covariance of what they whiten."""
    spark = vectors.sparkSession
    distinct = checkpointed(vectors.select("x").distinct())
    limbs = distinct.mapInArrow(_add_up(d), "i bigint, j bigint, place bigint, limb bigint").groupBy("i", "j", "place").agg(
        F.sum("limb").alias("limb")).collect()  # a few for each pair of dimensions
    cells: dict[tuple[int, int], int] = {}
    for r in limbs:
        cells[r.i, r.j] = cells.get((r.i, r.j), 0) + (r.limb << (LIMB * r.place))
    n, sums = cells.get((-1, 0), 0), [cells.get((d, j), 0) for j in range(d)]
    matrix = np.zeros((d, d), dtype=object)
    for i in range(d):
        for j in range(i + 1):
            matrix[i, j] = matrix[j, i] = n * cells.get((i, j), 0) - sums[i] * sums[j]
    fit = components_of(spark, matrix, n, sums, k)
    found = len(fit.values)
    if not found:
        return fit, 0.0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(found), np.zeros((found, found))
        for batch in batches:
            z = _projected(_centred(_matrix(batch.column(0), d), fit.n, fit.sums), fit)
            total, products = total + z.sum(axis=0), products + z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))],
            names=["total", "products"])

    def added(column: str, size: int):  # element by element, a few hundred numbers
        return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(size)]).alias(column)

    sums_of = distinct.mapInArrow(spread, "total array<double>, products array<double>").agg(
        added("total", found), added("products", found * found)).first()
    mean = np.array(sums_of.total) / n
    covariance = np.array(sums_of.products).reshape(found, found) / n - np.outer(mean, mean)
    return fit, float(np.abs(covariance - np.eye(found)).max())


def whiten(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """For each vector and each of the `k` largest components: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Vectors that are null or hold null or non-finite entries take no part; of vectors of different lengths, those of the
    most frequent length do (ties: the longer). Rows may repeat and have null ids: each gets its results, while equal
    vectors count once in the fit. Components of eigenvalue 0, which can't be scaled to 1, are left out: there are at most
    as many as the vectors' rank. Other columns than vec_id and embedding are not read. Without vectors, or with one distinct
    vector, there are no rows. Entries beyond 2 ** 56 count as that.
    """
    vectors = checkpointed(integer_vectors(rows))
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    fit, error = fit_components(vectors.where(F.size("x") == d), d, k)
    found = len(fit.values)
    if not found:
        vectors = vectors.where(F.lit(False))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                centred = _centred(_matrix(batch.column(1), d), fit.n, fit.sums)
                largest = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
                exact = centred if largest * largest * d < 1 << 62 else centred.astype(object)
                deviations = [str(v) for v in (exact * exact).sum(axis=1)]
                rows = np.repeat(np.arange(batch.num_rows), found)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(deviations, pa.string()).take(pa.array(rows)), pa.array(_projected(centred, fit).ravel()),
                    pa.array(np.tile(fit.explained, batch.num_rows)),
                ], names=["vec_id", "component", "deviation", "whitened", "explained"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.where(F.size("x") == d).mapInArrow(
        apply, f"vec_id {kind}, component int, deviation string, whitened double, explained double").select(
        "vec_id", "component", F.lit(fit.n).cast("bigint").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
