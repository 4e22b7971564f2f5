"""Whitening of embeddings by the exact spectrum of their integer scatter.

Entries become whole numbers, so the scatter of the distinct vectors is a
matrix of whole numbers that Spark sums up exactly. Its characteristic
polynomial is found modulo many primes by Hessenberg reduction, one row of a
DataFrame a prime, and put together by Chinese remainders. All its roots are
real, so counting sign changes of shifted coefficients counts roots exactly:
halving intervals isolates the largest ones and then narrows them as far as
wanted. Each component is the null space of the scatter less its eigenvalue,
by inverse iteration in whole numbers of a few hundred bits. Multiple and zero
eigenvalues are told from close and small ones, not guessed from rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut, table

#: An entry c becomes floor(SCALE c) + OFFSET; so many components are returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Eigenvalues are narrowed until the next one is so many times two further off than they are unsure.
CLOSE_BITS = 160
Poly = list[int]  # coefficients of whole numbers, that of x^0 first


# polynomials


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """The characteristic polynomial modulo a prime below 2^31, by reduction to Hessenberg form."""
    h, d = matrix.copy() % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # characteristic polynomials of the leading blocks
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        below, parts = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            parts[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        minors[k] = (minors[k] - (parts[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d].tolist()


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product is over twice the bound."""
    sieve = np.ones(46342, bool)
    sieve[:2] = False
    for i in range(2, 216):
        sieve[i * i :: i] = False
    small = np.flatnonzero(sieve)
    found, product, at = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if (at % small).all():
            found.append(at)
            product *= at
        at -= 2
    return found


def remaindered(primes: list[int], remainders: list[list[int]]) -> Poly:
    """The polynomial with these remainders whose coefficients are smaller than half the product of the primes."""
    total = math.prod(primes)
    weights = [total // p * pow(total // p, -1, p) for p in primes]
    values = [sum(w * r for w, r in zip(weights, own)) % total for own in zip(*remainders)]
    return [v - total if 2 * v > total else v for v in values]


def _divided(a: Poly, b: Poly) -> tuple[Poly, Poly]:
    """Quotient and remainder by a polynomial, a being scaled so that both are whole; for a monic b it is not."""
    a, quotient = a[:], [0] * max(1, len(a) - len(b) + 1)
    for shift in range(len(a) - len(b), -1, -1):
        if b[-1] != 1:
            a, quotient = [c * b[-1] for c in a], [c * b[-1] for c in quotient]
        factor = a[shift + len(b) - 1] // b[-1]
        quotient[shift] = factor
        for i, c in enumerate(b):
            a[shift + i] -= factor * c
    rest = a[: len(b) - 1]
    while rest and not rest[-1]:
        rest.pop()
    return quotient, rest


def _common(a: Poly, b: Poly) -> Poly:
    """The greatest common divisor, without a common factor of its coefficients."""
    while b:
        a, b = b, _divided(a, b)[1]
        b = [c // math.gcd(*b) for c in b] if b else b
    sign = 1 if a[-1] > 0 else -1
    return [sign * c // math.gcd(*a) for c in a]


def _slope(f: Poly) -> Poly:
    return [i * c for i, c in enumerate(f)][1:]


def _coprime_mod(a: Poly, b: Poly, p: int) -> bool:
    """Whether two polynomials, a monic, have no common divisor modulo a prime; then they have none at all."""
    a, b = [c % p for c in a], [c % p for c in b]
    while b and not b[-1]:
        b.pop()
    while b:
        inverse = pow(b[-1], -1, p)
        for shift in range(len(a) - len(b), -1, -1):
            factor = a[shift + len(b) - 1] * inverse % p
            for i, c in enumerate(b):
                a[shift + i] = (a[shift + i] - factor * c) % p
        a = a[: len(b) - 1]
        while a and not a[-1]:
            a.pop()
        a, b = b, a
    return len(a) == 1


def without_squares(f: Poly) -> list[tuple[Poly, int]]:
    """Factors of a monic polynomial that have each root once, with how often they are in it."""
    slope = _slope(f)
    if len(f) < 3 or _coprime_mod(f, slope, (1 << 31) - 1):
        return [(f, 1)] if len(f) > 1 else []
    common = _common(f, slope)
    rest, out, times = _divided(f, common)[0], [], 1
    while len(rest) > 1:
        shared = _common(rest, common)
        own = _divided(rest, shared)[0]
        if len(own) > 1:
            out.append((own, times))
        rest, common, times = shared, _divided(common, shared)[0], times + 1
    return out


def _value(f: Poly, at: int, bits: int) -> int:
    """A number with the sign of f(at / 2^bits)."""
    if bits < 0:
        at, bits = at << -bits, 0
    out, scale = 0, 0
    for c in reversed(f):
        out = out * at + (c << scale)
        scale += bits
    return out


def roots_above(f: Poly, at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only lie above at / 2^bits: sign changes after a shift."""
    if bits < 0:
        at, bits = at << -bits, 0
    degree = len(f) - 1
    shifted = [c << bits * (degree - i) for i, c in enumerate(f)]
    for k in range(degree):
        for i in range(degree - 1, k - 1, -1):
            shifted[i] += at * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _isolated(f: Poly, high: int, most: int) -> list[tuple[int, int]]:
    """`(end, bits)` for the `most` largest roots of a polynomial with different real roots, all in (0, high].

    Exactly one root lies in ((end - 1) / 2^bits, end / 2^bits], largest first.
    """
    out: list[tuple[int, int]] = []
    todo = [(1, -high.bit_length(), 0, len(f) - 1)]  # with the roots above the end and above the start
    while todo and len(out) < most:
        end, bits, above, from_start = todo.pop()
        if from_start - above == 1:
            out.append((end, bits))
        elif from_start > above:
            middle = roots_above(f, 2 * end - 1, bits + 1)
            todo += [(2 * end - 1, bits + 1, middle, from_start), (2 * end, bits + 1, above, middle)]
    return out


def _narrowed(f: Poly, end: int, bits: int, more: int) -> tuple[int, int]:
    """The interval of one root halved `more` times."""
    if not (last := _value(f, end, bits)):
        return end << more, bits + more
    for _ in range(more):
        end, bits = 2 * end, bits + 1
        inner = _value(f, end - 1, bits)
        if not inner:
            return _narrowed(f, end - 1, bits, more - 1) if more > 1 else (end - 1, bits)
        if (inner > 0) != (last > 0):
            continue
        end -= 1
    return end, bits


def largest_roots(f: Poly, high: int, most: int) -> list[tuple[Fraction, int]]:
    """`(root, times)` of the largest positive roots, until `most` are found, counting multiple ones as often as they are there.

    `f` is monic, all its roots are real, none is above `high` or below 0.
    Each root is narrowed until the next one is 2^CLOSE_BITS times further off
    than it is unsure.
    """
    zeros = next(i for i, c in enumerate(f) if c)
    held = []
    for factor, times in without_squares(f[zeros:]):
        held += [(factor, end, bits, times) for end, bits in _isolated(factor, high, most + 1)]
    step = 64
    while True:
        held = [(g, *_narrowed(g, end, bits, step), times) for g, end, bits, times in held]
        ends = sorted(((Fraction(end, 1 << bits) if bits >= 0 else Fraction(end << -bits)), 1 / Fraction(2) ** bits, times) for _, end, bits, times in held)
        wide = max((w for _, w, _ in ends), default=Fraction(0))
        if all(b[0] - a[0] > wide * (1 << CLOSE_BITS) for a, b in zip([(Fraction(0),)] + ends, ends)):
            break
    out, found = [], 0
    for value, _, times in reversed(ends):
        if found >= most:
            break
        out.append((value, times))
        found += times
    return out


# null spaces


def _solved(matrix: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The solution of a system of whole numbers, in fixed point of so many bits; a pivot of 0 counts as 1."""
    a, b, d = matrix.copy(), right.copy(), len(matrix)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[pivot, k]], b[[pivot, k]] = a[[k, pivot]], b[[k, pivot]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factors = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k:] -= (factors[:, None] * a[k, k:]) >> bits
            b[k + 1 :] -= (factors[:, None] * b[k]) >> bits
    out = np.zeros_like(b)
    for k in range(d - 1, -1, -1):
        rest = b[k] - (((a[k, k + 1 :, None] * out[k + 1 :]) >> bits).sum(axis=0) if k + 1 < d else 0)
        out[k] = (rest << bits) // a[k, k]
    return out


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(sum(int(x) ** 2 for x in v))
    return np.array([(int(x) << bits) // length for x in v], dtype=object)


def null_space(scatter: list[list[int]], value: Fraction, times: int) -> list[list[float]]:
    """Orthogonal unit vectors that the scatter multiplies by `value`, an eigenvalue that it has `times` times."""
    d = len(scatter)
    shift = value.denominator.bit_length() - 1
    bits = CLOSE_BITS + shift + max(1, sum(scatter[i][i] for i in range(d))).bit_length()
    matrix = np.array(scatter, dtype=object) * (value.denominator << bits)
    for i in range(d):
        matrix[i, i] -= value.numerator << bits
    found = np.array([[((i + 1) * (i + 2) * (k + 3) * 7919 % 10007 - 5003) << bits for k in range(times)] for i in range(d)], dtype=object)
    for _ in range(2):
        found = _solved(matrix, found, bits)
        done: list[np.ndarray] = []
        for k in range(times):
            v = _unit(found[:, k], bits)
            for before in done:
                v = v - (before * (sum(v * before) >> bits) >> bits)
            done.append(_unit(v, bits))
        found = np.array(done, dtype=object).T
    return [[float(Fraction(int(x), 1 << bits)) for x in v] for v in done]


# Spark


def whole_entries(vector: Column) -> Column:
    """floor(SCALE c) + OFFSET of each entry; null if the vector is null or has an entry that is null or not finite."""
    wide = vector.cast("array<double>")
    wrong = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~wrong, F.transform(wide, lambda c: F.floor(c * SCALE) + OFFSET))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            held = batch.column(column)
            yield batch, held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _added(vectors: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], exact: bool) -> dict[int, int | float]:
    """Sums over all vectors of what a function makes of a matrix of them: added up in each task, then by Spark.

    As many numbers reach the driver as the function gives for one matrix.
    """
    kind = "decimal(38,0)" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, x in _matrices(batches, 0):
            own = of_batch(x)
            sums = own if sums is None else sums + own
        if sums is not None:
            values = pa.array([Decimal(int(v)) for v in sums], pa.decimal128(38, 0)) if exact else pa.array(sums, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), values], ["k", "v"])

    rows = vectors.select("x").mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return {r["k"]: int(r["v"]) if exact else r["v"] for r in rows}


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products of each two columns i <= j of whole numbers, exactly."""
    d = y.shape[1]
    above = np.triu_indices(d)
    most = int(np.abs(y).max(initial=0))
    rows = (1 << 53) // max(1, most * most)
    total = np.zeros((d, d), dtype=object)
    for begin in range(0, len(y), max(1, min(rows, len(y)))):
        part = y[begin : begin + max(1, min(rows, len(y)))]
        # below 2^53 a product of doubles is exact
        own = (part.astype(np.float64).T @ part.astype(np.float64)).astype(np.int64) if rows else part.astype(object).T @ part.astype(object)
        total = total + own.astype(object)
    return total[above]


def _each(spark: SparkSession, items: list[str], work: Callable[[str], list], kind: str, parts: int) -> list[list]:
    """What a function makes of each string, in order, one row and task each."""
    frame = spark.createDataFrame(list(enumerate(items)), "i int, item string").repartition(parts, "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(item) for item in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["i", "made"])

    return [r["made"] for r in sorted(frame.mapInArrow(run, f"i int, made {kind}").collect())]


def scatter_of(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """`n, sums, scatter` of the rows `x`: scatter is n^2 times their covariance, centred before multiplying, exact."""
    n = vectors.count()
    added = _added(vectors, lambda x: x.astype(object).sum(axis=0), exact=True)
    sums = [added[k] for k in range(len(added))]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    own = np.array(middle, dtype=np.int64)
    products = _added(vectors, lambda x: _products(x - own), exact=True)
    d, rest = len(sums), [s - n * m for s, m in zip(sums, middle)]
    scatter = [[0] * d for _ in range(d)]
    for k, (i, j) in enumerate(zip(*(t.tolist() for t in np.triu_indices(d)))):
        scatter[i][j] = scatter[j][i] = n * products[k] - rest[i] * rest[j]
    return n, sums, scatter


def charpoly(spark: SparkSession, scatter: list[list[int]]) -> Poly:
    """The characteristic polynomial of a symmetric matrix without negative eigenvalues."""
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))  # by Maclaurin's inequality
    primes = primes_for(bound)

    def work(prime: str) -> list[int]:
        p = int(prime)
        return charpoly_mod(np.array([[v % p for v in row] for row in scatter], dtype=np.int64), p)

    return remaindered(primes, _each(spark, [str(p) for p in primes], work, "array<long>", min(len(primes), 32)))


def spectrum(spark: SparkSession, scatter: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """`(eigenvalue, unit vector)` of the largest positive eigenvalues, in falling order."""
    trace = sum(scatter[i][i] for i in range(len(scatter)))
    if not trace:
        return []
    roots = largest_roots(charpoly(spark, scatter), trace, most)

    def work(item: str) -> list[list[float]]:
        value, times = item.split()
        return null_space(scatter, Fraction(value), int(times))

    found = _each(spark, [f"{value} {times}" for value, times in roots], work, "array<array<double>>", len(roots))
    return [(value, v) for (value, _), own in zip(roots, found) for v in own][:most]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """`id, component, n, deviation, whitened, explained, identity_error` of each vector and component.

    Vectors that are null or have an entry that is null or not finite are left
    out, and so are those shorter than the longest one, as they lack entries.
    Repeated vectors count once in the fit and have rows each; other columns
    are ignored. Components with an eigenvalue of exactly 0 are not returned:
    with one distinct vector, or none, there are no rows. Entries beyond 10^16,
    or a `deviation` that doesn't fit a long, make the job fail.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), whole_entries(F.col(vector_col)).alias("x")).filter("x is not null")
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.filter(F.size("x") == d)
    distinct = cut(rows.select("x").distinct(), "vectors")
    if not d:
        return spark.createDataFrame([], schema)
    n, sums, scatter = scatter_of(distinct)
    found = spectrum(spark, scatter, most)
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(scatter[i][i] for i in range(d))
    to_whole = np.array([v for _, v in found]).T * (n / np.sqrt([float(value) for value, _ in found]))  # an eigenvalue of V is value / n^2
    explained = [float(value / trace) for value, _ in found]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)])
    k = len(found)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - rest) @ to_whole

    means = _added(distinct, lambda x: project(x).sum(axis=0), exact=False)
    mean = np.array([means[i] / n for i in range(k)])

    def spread(x: np.ndarray) -> np.ndarray:
        w = project(x) - mean
        return (w.T @ w).ravel()

    products = _added(distinct, spread, exact=False)
    error = float(np.abs(np.array([products[i] / n for i in range(k * k)]).reshape(k, k) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1):
            far = (int(np.abs(x - middle).max()) + 1) * n
            kind = np.int64 if far < 1 << 62 and d * far * far < 1 << 63 else object
            off = x.astype(kind) * n - np.array(sums, dtype=kind)
            deviation = pa.array([int(v) for v in (off * off).sum(axis=1)], pa.int64())
            each, m = np.repeat(np.arange(len(x)), k), len(x)
            columns = [batch.column(0).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n, np.int64), deviation.take(pa.array(each))]
            columns += [project(x).ravel(), np.tile(np.array(explained), m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings`, whitened to 16 components."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
