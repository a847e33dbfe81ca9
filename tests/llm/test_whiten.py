"""Whitening against exact and plain numpy results."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinline.llm import whiten as w


def plain_polynomial(matrix):
    """Faddeev and Le Verrier's way, with fractions."""
    d = len(matrix)
    coefficients, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(d)) + (coefficients[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        trace = sum(matrix[i][l] * m[l][i] for i in range(d) for l in range(d))
        coefficients.append(Fraction(-trace, k))
    return [int(c) for c in reversed(coefficients)]


def gram(rows):
    return [[sum(a * b for a, b in zip(x, y)) for y in rows] for x in rows]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=d, max_size=d)))
def test_polynomial_modulo_a_prime(rows):
    matrix = gram(rows)  # of rank 2 at most, so pivots vanish
    p = (1 << 31) - 1
    assert w.polynomial_modulo(np.array(matrix, np.int64) % p, p) == [c % p for c in plain_polynomial(matrix)]


def test_primes():
    assert [n for n in range(9, 400, 2) if w._is_prime(n)] == [n for n in range(9, 400, 2) if all(n % k for k in range(2, n))]
    assert w._is_prime((1 << 31) - 1) and not w._is_prime((1 << 31) - 3)


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(1)
    matrix = gram(rng.integers(-(10**9), 10**9, (7, 9)).tolist())
    assert w.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)


def polynomial_of(roots):
    made = [1]
    for r in roots:
        made = [a - r * b for a, b in zip([0, *made], [*made, 0])]
    return made


@pytest.mark.parametrize("roots", [[5], [0, 0], [7, 7, 7, 3, 0], [10**30, 10**30 - 1, 1, 1], [2, 1, 0, 0], [9, 4, 4, 1]])
def test_largest_roots_with_repeats(roots):
    got = w.largest_roots(polynomial_of(roots), 4, max(sum(roots), 1))
    want = sorted(roots, reverse=True)[:4]
    assert [Fraction(n, 1 << b) for n, b in got] == want
    assert [w.roots_above(polynomial_of(roots), c) for c in (0, 3, 4)] == [sum(r > c for r in roots) for c in (0, 3, 4)]


def test_irrational_roots_to_many_digits():
    (a, bits), (b, more) = w.largest_roots([1, -4, 1], 2, 4)  # 2 +- sqrt(3)
    assert abs(Fraction(a, 1 << bits) + Fraction(b, 1 << more) - 4) < Fraction(1, 1 << 150)
    assert math.isclose(a / 2**bits, 2 + math.sqrt(3), rel_tol=1e-15) and math.isclose(b / 2**more, 2 - math.sqrt(3), rel_tol=1e-15)


def plain(vectors, count=4, scale=256):
    """{row: rows of (component, n, deviation, explained)} and the whitened matrix, in plain numpy."""
    x = [[math.floor(scale * c) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, total = len(fit), fit.sum(0)
    centred = (fit * n - total).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, total)) for v in x]
    made = (np.array(x, float) - (total / n).astype(float)) @ axes / np.sqrt(values)
    return n, deviation, values / (centred**2).sum() * n, made


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(400, 12)) * np.geomspace(1, 0.05, 12)).astype(np.float32).astype(float).tolist()
    vectors += vectors[:50] * 3  # copies count once
    rows = [(i, v, "x", i) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, whitened long").repartition(5)
    n, deviation, explained, made = plain(vectors)
    got = w.whiten(df).collect()
    assert len(got) == 4 * len(vectors)
    by_component = [[r for r in sorted(got, key=lambda r: r.vec_id) if r.component == k] for k in (1, 2, 3, 4)]
    for k, part in enumerate(by_component):
        assert [r.vec_id for r in part] == list(range(len(vectors)))
        assert {r.n for r in part} == {n} and [int(r.deviation) for r in part] == deviation
        assert np.isclose(part[0].explained, explained[k], rtol=1e-9) and 0 <= part[0].identity_error < 1e-10
        mine = np.array([r.whitened for r in part])
        assert min(np.abs(mine - made[:, k]).max(), np.abs(mine + made[:, k]).max()) < 1e-8
    assert len({r.identity_error for r in got}) == 1


def test_equal_eigenvalues_give_orthonormal_components(spark):
    d = 5
    vectors = [[float(s) if i == k else 0.0 for i in range(d)] for k in range(d) for s in (1, -1)] + [[0.0] * d]
    got = w.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert {round(r.explained, 12) for r in got} == {0.2} and got[0].identity_error < 1e-12


def test_very_close_eigenvalues():
    big = 10**14
    matrix = [[big, 1, 0], [1, big, 0], [0, 0, 3]]  # roots big + 1, big - 1 and 3
    roots = w.largest_roots(plain_polynomial(matrix), 3, 2 * big + 3)
    assert [Fraction(n, 1 << b) for n, b in roots] == [big + 1, big - 1, 3]
    first, second, third = (w.null_vectors(matrix, r, 1)[0] for r in roots)
    half = math.sqrt(0.5)
    assert np.allclose(np.abs(first), [half, half, 0], atol=1e-15) and first[0] * first[1] > 0
    assert np.allclose(np.abs(second), [half, half, 0], atol=1e-15) and second[0] * second[1] < 0
    assert np.allclose(np.abs(third), [0, 0, 1], atol=1e-15)


def test_exact_sums_of_large_entries(spark):
    x = [[2**62, -(2**62), 5], [-(2**61) + 7, 3, -1], [2**62, -(2**62), 6], [0, 0, 0]]
    rows = [(bytes(b),) for b in w.packed(np.array(x, np.int64))]
    n, total, matrix = w.scatter(spark.createDataFrame(rows, "x binary").repartition(3), 3)
    assert (n, total) == (4, [sum(v[i] for v in x) for i in range(3)])
    assert matrix == [[4 * sum(v[i] * v[j] for v in x) - total[i] * total[j] for j in range(3)] for i in range(3)]
    assert w._squares(np.array(x, np.int64), n, total) == [sum((n * a - s) ** 2 for a, s in zip(v, total)) for v in x]


def test_packing_is_one_to_one():
    rows = np.array([[127, -128], [128, 0], [-32768, 1], [40000, -1], [2**40, 0], [-1, -1]], np.int64)
    made = w.packed(rows)
    assert len(set(made)) == len(rows) and [m[0] for m in made] == [1, 2, 2, 4, 8, 1]
    assert sorted(map(tuple, w.unpacked(made).tolist())) == sorted(map(tuple, rows.tolist()))


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [0.5, 1.0]), (2, None), (3, []), (4, [0.5, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [0.25, -1.0]),
        (1, [0.5, 1.0]), (8, [0.0, 0.0]), (9, [-0.001, 0.0]),
    ]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id for r in got if r.component == 1), key=str) == sorted([1, 1, None, 8, 9], key=str)
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    (below,) = {int(r.deviation) for r in got if r.vec_id == 9}
    x = [(128, 256), (64, -256), (0, 0), (-1, 0)]  # -0.256 falls to -1
    assert below == sum((4 * a - s) ** 2 for a, s in zip((-1, 0), map(sum, zip(*x))))


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    same = w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in same)
    line = w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [4.0, 2.0])], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and {r.explained for r in line} == {1.0, 0.0}
    assert w.whiten(spark.createDataFrame([], schema)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.7e308])]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    top, bottom = w.LONGEST, -w.LONGEST - 1
    x = [(top, 0), (bottom, 256), (0, top)]
    total = [sum(v[i] for v in x) for i in range(2)]
    want = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, total)) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: Decimal(s) if s < 10**38 else None for i, s in want.items()}
