"""Whitening against plain linear algebra, and the exact parts against hand-worked cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidelog.llm import whitening as w


def exact_polynomial(matrix):
    d = len(matrix)
    bound = max(math.comb(d, k) * (sum(matrix[i][i] for i in range(d)) // d + 1) ** k for k in range(d + 1))
    primes = w.primes_for(bound)
    return w.remaindered(primes, [w.charpoly_mod(np.array([[v % p for v in row] for row in matrix], dtype=np.int64), p) for p in primes])


def by_fractions(matrix):
    """The characteristic polynomial by Faddeev and LeVerrier's recurrence, coefficient of x^0 first."""
    a = np.array(matrix, dtype=object)
    d, m, out = len(a), np.zeros_like(a), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + out[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
        out.append(-sum(a.dot(m)[i, i] for i in range(d)) // k)
    return [int(c) for c in reversed(out)]


def gram(seed, rows, d, high=60):
    draw = random.Random(seed)
    m = [[draw.randint(-high, high) for _ in range(d)] for _ in range(rows)]
    return [[sum(r[i] * r[j] for r in m) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("rows, d", [(1, 1), (3, 1), (9, 4), (4, 9), (12, 12), (30, 7)])
def test_polynomial_is_exact(rows, d):
    matrix = gram(rows * 31 + d, rows, d)
    assert exact_polynomial(matrix) == by_fractions(matrix)


def test_polynomial_of_sparse_and_zero_matrices():
    for matrix in ([[0, 0], [0, 0]], [[2, 0, 0], [0, 2, 0], [0, 0, 7]], [[1, 0, 1], [0, 5, 0], [1, 0, 1]]):
        assert exact_polynomial(matrix) == by_fractions(matrix)


def test_roots_with_their_multiplicities():
    f = [1]
    for root in (5, 5, 5, 3, 8, 8, 0, 0):
        f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    assert w.largest_roots(f, 37, 6) == [(8, 2), (5, 3), (3, 1)]
    assert w.largest_roots(f, 37, 2) == [(8, 2)]
    assert w.roots_above(f, 5, 0) == 2 and w.roots_above(f, 9, 1) == 5  # above 4.5


def test_close_roots_are_told_apart():
    big = 10**12
    f = [1]
    for root in (big, big + 1, big + 3, 2):
        f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    assert w.largest_roots(f, 4 * big, 3) == [(big + 3, 1), (big + 1, 1), (big, 1)]


def test_components_of_close_eigenvalues():
    # eigenvalues 10^9 + 1 and 10^9 - 1 along (1, 1) and (1, -1)
    matrix = [[10**9, 1, 0], [1, 10**9, 0], [0, 0, 4]]
    (first, _), (second, _) = w.largest_roots(exact_polynomial(matrix), 2 * 10**9 + 4, 2)
    assert (first, second) == (10**9 + 1, 10**9 - 1)
    half = math.sqrt(0.5)
    for value, expected in ((first, (half, half, 0)), (second, (half, -half, 0))):
        v = np.array(w.null_space(matrix, value, 1)[0])
        assert min(np.abs(v - expected).max(), np.abs(v + expected).max()) < 1e-15


def test_space_of_a_multiple_eigenvalue():
    matrix = [[5, 0, 0, 0], [0, 2, 0, 0], [0, 0, 5, 0], [0, 0, 0, 5]]
    vectors = np.array(w.null_space(matrix, Fraction(5), 3))
    assert np.abs(vectors @ vectors.T - np.eye(3)).max() < 1e-15 and np.abs(vectors[:, 1]).max() < 1e-15


def whitened(spark, rows, most=16):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, x int, n string, component double")
    return w.whiten(frame, most=most).collect()


def vectors(seed, n, d):
    draw = random.Random(seed)
    return [[draw.gauss(0, 1 + j / 3) for j in range(d)] for _ in range(n)]


def rows_of(found):
    return [(i, v, 0, "clash", 1, "clash", 2.5) for i, v in enumerate(found)]


def test_equals_linear_algebra(spark):
    data = vectors(5, 80, 6)
    rows = rows_of(data + [data[0], data[0], data[3]] + [None, [], [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] + [0.0] * 5, [1.0] * 4])
    got = whitened(spark, rows + rows[:1], 4)
    used = [0] + list(range(83))
    assert len(got) == 4 * len(used) and {r["id"] for r in got} == set(range(83))
    x = np.floor(64 * np.array([rows[i][1] for i in range(83)], dtype=np.float32).astype(float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n = len(fit)
    assert {r["n"] for r in got} == {n}
    covariance = np.cov(fit.T, bias=True)
    values, parts = np.linalg.eigh(covariance)
    for r in got:
        value, part = values[-r["component"]], parts[:, -r["component"]]
        expected = (x[r["id"]] - fit.mean(axis=0)) @ part / math.sqrt(value)
        assert abs(abs(r["whitened"]) - abs(expected)) < 1e-9
        assert abs(r["explained"] - value / np.trace(covariance)) < 1e-12
        z = [n * int(a) - int(s) for a, s in zip(x[r["id"]], fit.sum(axis=0))]
        assert r["deviation"] == sum(v * v for v in z)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for c in range(1, 5):  # one sign for all rows
        mine = np.array([next(r["whitened"] for r in got if r["id"] == i and r["component"] == c) for i in range(83)])
        plain = (x - fit.mean(axis=0)) @ parts[:, -c] / math.sqrt(values[-c])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-9


def test_dependent_constant_and_few_vectors(spark):
    flat = [[v[0], 2.0, v[0], -v[0]] for v in vectors(7, 20, 1)]
    assert {r["component"] for r in whitened(spark, rows_of(flat))} == {1}  # four dimensions, three of them bound to the first
    line = [[float(i), 3.0 * i, 0.0] for i in range(9)]
    found = whitened(spark, rows_of(line))
    assert {r["component"] for r in found} == {1} and abs(found[0]["explained"] - 1) < 1e-15
    assert whitened(spark, rows_of([[1.0, 2.0]] * 4)) == []
    assert whitened(spark, rows_of([])) == [] and whitened(spark, rows_of([None, []])) == []


def test_equal_eigenvalues_keep_the_identity(spark):
    # the corners of a cube and of its mirror images: one eigenvalue, three times
    cube = [[float(a), float(b), float(c)] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    found = whitened(spark, rows_of(cube))
    assert {r["component"] for r in found} == {1, 2, 3} and found[0]["identity_error"] < 1e-14
    assert {round(r["explained"], 12) for r in found} == {round(1 / 3, 12)}


def test_far_entries_are_exact(spark):
    far = [[1e6 + i, float(i * i)] for i in range(40)]
    found = whitened(spark, rows_of(far))
    x = np.floor(64 * np.array(far, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    sums = x.sum(axis=0)
    by = {r["id"]: r for r in found}
    assert all(by[i]["deviation"] == sum((40 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) for i in range(40))
    assert found[0]["identity_error"] < 1e-9
