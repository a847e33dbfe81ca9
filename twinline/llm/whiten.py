"""Whitening of vectors by exact principal components.

Entries are made integers, so the scatter matrix of the distinct vectors is a matrix of
integers that Spark sums without rounding. Its characteristic polynomial is computed
modulo many primes, a task for each few of them, through a Hessenberg form, and put
together by the Chinese remainder theorem. All roots of it are real, so the sign changes
of the polynomial moved to c count just the roots above c, repeated ones too: halving
intervals isolates the largest ones to any precision. The components are the null space
of scatter minus root, found by inverse iteration in decimal arithmetic.

What goes through the driver depends on the dimension alone, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.session import ship, written

SCALE = 256
# Bits of a limb: products of limbs, summed over LIMB_ROWS rows, are exact as doubles.
LIMB_BITS, LIMB_ROWS = 20, 4096
# Bits of a piece in which a task tells a sum.
PIECE_BITS = 40
# Significant bits of a root, and digits of the arithmetic for the components.
ROOT_BITS, DIGITS = 160, 90
LONGEST = (1 << 63) - 1


def whole_vectors(column: pa.Array | pa.ChunkedArray, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) for each length of vector: floor(scale * entry) of usable rows.

    Not usable: null, empty, with a null or non-finite entry. Beyond a long, the nearest long.
    """
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    entries = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), sizes)
    usable = (sizes > 0) & (np.bincount(owner, ~np.isfinite(entries), len(lists)) == 0)
    with np.errstate(over="ignore"):
        scaled = np.floor(entries * scale)
    top, bottom = scaled >= 2.0**63, scaled < -(2.0**63)
    values = np.where(top | bottom | ~np.isfinite(scaled), 0, scaled).astype(np.int64)
    values = np.where(top, LONGEST, np.where(bottom, -LONGEST - 1, values))
    starts = np.cumsum(sizes) - sizes
    found = []
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        found.append((rows, values[starts[rows][:, None] + np.arange(size)]))
    return found


def packed(matrix: np.ndarray) -> list[bytes]:
    """Each row as the bytes of an entry (1, 2, 4 or 8) and all entries; equal rows give equal bytes."""
    most = np.maximum(matrix.max(1), -(matrix.min(1) + 1))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    made = [b""] * len(matrix)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        data, step = matrix[rows].astype(f"<i{w}").tobytes(), w * matrix.shape[1]
        for k, row in enumerate(rows.tolist()):
            made[row] = bytes((w,)) + data[k * step : (k + 1) * step]
    return made


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The matrix of rows of one length (in any order)."""
    by_width: dict[int, list[bytes]] = {}
    for row in rows:
        by_width.setdefault(row[0], []).append(row[1:])
    parts = [np.frombuffer(b"".join(same), f"<i{w}").reshape(len(same), -1).astype(np.int64) for w, same in by_width.items()]
    return np.concatenate(parts)


def distinct_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``(size, x)``: each distinct integer vector once, packed. Copies fold within tasks first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in whole_vectors(batch.column(0), scale):
                x = list(dict.fromkeys(packed(matrix)))
                size = np.full(len(x), matrix.shape[1], np.int32)
                yield pa.RecordBatch.from_pydict({"size": pa.array(size), "x": pa.array(x, pa.binary())})

    return df.select(vector).mapInArrow(scan, "size int, x binary").distinct()


def _limbs(matrix: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2^LIMB_BITS once more than the one before, is ``matrix``."""
    limbs = []
    while True:
        if not len(matrix) or max(int(matrix.max()), -int(matrix.min())) < 1 << LIMB_BITS:
            return [*limbs, matrix.astype(np.float64)]
        limbs.append((matrix & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        matrix = matrix >> LIMB_BITS


def _pieces(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(power, longs): Python integers in pieces of PIECE_BITS, the last one signed."""
    power = 0
    while True:
        if max(abs(int(v)) for v in values) < 1 << PIECE_BITS:
            yield power, values.astype(np.int64)
            return
        yield power, (values & ((1 << PIECE_BITS) - 1)).astype(np.int64)
        values = values >> PIECE_BITS
        power += 1


def scatter(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Of n vectors x: n, their sums S, and n * sum(x x') - S S', all exact.

    Tasks sum over all their rows and tell each number in pieces that Spark adds as longs.
    """
    high, low = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, totals, n = np.zeros(len(high), object), np.zeros(size, object), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = unpacked(batch.column(0).to_pylist())
            n += len(matrix)
            for at in range(0, len(matrix), LIMB_ROWS):
                limbs = _limbs(matrix[at : at + LIMB_ROWS])
                for i, a in enumerate(limbs):
                    totals += a.sum(0).astype(np.int64).astype(object) << (LIMB_BITS * i)
                    for j, b in enumerate(limbs):
                        products += (a.T @ b)[high, low].astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
        if n:
            for power, part in _pieces(np.concatenate([[n], totals, products])):
                at = np.arange(len(part), dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"place": at, "power": np.full(len(part), power, np.int32), "part": part})

    told = fit.select("x").mapInArrow(sums, "place int, power int, part long")
    values = [0] * (1 + size + len(high))
    for row in told.groupBy("place", "power").agg(F.sum("part").alias("part")).collect():
        values[row.place] += row.part << (PIECE_BITS * row.power)
    n, total, products = values[0], values[1 : 1 + size], values[1 + size :]
    matrix = [[0] * size for _ in range(size)]
    for i, j, p in zip(high.tolist(), low.tolist(), products):
        matrix[i][j] = matrix[j][i] = n * p - total[i] * total[j]
    return n, total, matrix


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo the prime ``p`` < 2^31, the constant first."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        row = k + 1 + int(below[0])
        if row != k + 1:
            h[[row, k + 1]] = h[[k + 1, row]]
            h[:, [row, k + 1]] = h[:, [k + 1, row]]
        times = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - times[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * times % p).sum(1)) % p
    # The leading k rows and columns have the polynomial of row k.
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(1, d + 1):
        weights, chain = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else 0
        moved = np.roll(polynomials[k - 1], 1)
        polynomials[k] = (moved - (polynomials[:k] * weights[:, None] % p).sum(0)) % p
    return polynomials[d].tolist()


def _is_prime(n: int) -> bool:
    """For odd n from 9 to 2^32 (bases 2, 3, 5 and 7 are enough there)."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), the constant first, for a matrix without negative roots."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # A coefficient is a sum of products of roots, whose sum is the trace.
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes, product, p = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if _is_prime(p):
            primes.append(p)
            product *= p
        p -= 2

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                rest = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pa.RecordBatch.from_pydict({"p": [p], "coefficients": pa.array([polynomial_modulo(rest, p)], pa.list_(pa.int64()))})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    values, modulus = [0] * (d + 1), 1
    for p, coefficients in rows.mapInArrow(reduced, "p long, coefficients array<long>").collect():
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((c - v) * inverse % p) for v, c in zip(values, coefficients)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def roots_above(coefficients: list[int], c: int) -> int:
    """How many roots, each as often as it is one, lie above ``c``, if all are real."""
    moved = list(coefficients)
    for i in range(len(moved) - 1):
        for j in range(len(moved) - 2, i - 1, -1):
            moved[j] += c * moved[j + 1]
    signs = [v > 0 for v in moved if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _scaled(coefficients: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are those of ``coefficients`` times 2^bits."""
    d = len(coefficients) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(coefficients)]


def _sign(coefficients: list[int], at: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], count: int, bound: int) -> list[tuple[int, int]]:
    """The ``count`` largest roots, falling, as (number, bits): number / 2^bits.

    For a polynomial with real roots from 0 to ``bound``. A positive root keeps ROOT_BITS
    significant bits; roots that agree in all of them come as equal numbers.
    """
    d = len(coefficients) - 1
    zero = next(i for i, c in enumerate(coefficients) if c)  # roots that are 0
    found: list[tuple[int, int]] = []
    for k in range(1, min(count, d) + 1):
        if k > d - zero:
            found.append((0, 0))
            continue
        bits, polynomial = 0, coefficients
        low, high, above_low, above_high = 0, bound + 1, d - zero, 0  # in 2^-bits; the root is in (low, high]
        while True:
            while high - low > 1:
                middle = (low + high) // 2
                if above_low - above_high == 1:  # one simple root is left: its sign tells the side
                    side = _sign(polynomial, middle) == _sign(polynomial, high) or _sign(polynomial, middle) == 0
                    if _sign(polynomial, high) == 0:
                        side = False
                    low, high = (low, middle) if side else (middle, high)
                    continue
                above = roots_above(polynomial, middle)
                if above >= k:
                    low, above_low = middle, above
                else:
                    high, above_high = middle, above
            more = ROOT_BITS - high.bit_length()
            if more <= 0:
                break
            # Few bits are known yet: go on in finer steps.
            polynomial, bits = _scaled(polynomial, more), bits + more
            low, high = low << more, high << more
        found.append((high, bits))
    return found


def null_vectors(matrix: list[list[int]], root: tuple[int, int], count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that ``matrix`` minus the root nearly maps to 0.

    Inverse iteration: with one factorization, vectors are solved for again and again, and
    held orthogonal to those found before.
    """
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        shift = Decimal(root[0]) / (1 << root[1])
        rows = [[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        least = max((abs(v) for row in rows for v in row), default=Decimal(0)).scaleb(-DIGITS + 5) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best] = rows[best], rows[k]
            order[k], order[best] = order[best], order[k]
            if abs(rows[k][k]) < least:
                rows[k][k] = least
            top = rows[k]
            for i in range(k + 1, d):
                row = rows[i]
                if row[k]:
                    times = row[k] = row[k] / top[k]
                    for j in range(k + 1, d):
                        row[j] -= times * top[j]
        found: list[list[Decimal]] = []
        for nth in range(count):
            vector = [Decimal(1 + (i * 37 + nth * 11 + i * i * nth) % 17) for i in range(d)]
            for _ in range(4):
                vector = [vector[i] for i in order]
                for i in range(d):
                    vector[i] -= sum((rows[i][j] * vector[j] for j in range(i)), Decimal(0))
                for i in range(d - 1, -1, -1):
                    vector[i] = (vector[i] - sum((rows[i][j] * vector[j] for j in range(i + 1, d)), Decimal(0))) / rows[i][i]
                for _ in range(2):
                    for other in found:
                        along = sum((a * b for a, b in zip(vector, other)), Decimal(0))
                        vector = [a - along * b for a, b in zip(vector, other)]
                norm = sum((a * a for a in vector), Decimal(0)).sqrt()
                vector = [a / norm for a in vector]
            # Of both signs, the one that makes the largest entry positive.
            if max(vector, key=abs) < 0:
                vector = [-a for a in vector]
            found.append(vector)
        return [[float(a) for a in vector] for vector in found]


def principal_components(spark: SparkSession, n: int, matrix: list[list[int]], count: int) -> tuple[list[float], list[float], np.ndarray]:
    """(eigenvalues, shares of the trace, unit vectors as rows) of the covariance, falling."""
    count = min(count, len(matrix))
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [0.0] * count, [0.0] * count, np.eye(count, len(matrix))
    roots = largest_roots(characteristic_polynomial(spark, matrix), count, trace)
    vectors: list[list[float]] = []
    for root in dict.fromkeys(roots):
        vectors += null_vectors(matrix, root, roots.count(root))
    with localcontext(Context(prec=DIGITS)):
        exact = [Decimal(number) / (1 << bits) for number, bits in roots]
        return [float(r / n / n) for r in exact], [float(r / trace) for r in exact], np.array(vectors)


def _squares(matrix: np.ndarray, n: int, total: list[int]) -> list[int]:
    """sum((n * x - S)^2) of each row, exact."""
    most = max(int(matrix.max()), -int(matrix.min()), 1)
    fits = most * max(most, *(abs(s) for s in total)) * len(total) < 1 << 63
    x = matrix if fits else matrix.astype(object)
    own, cross = (x * x).sum(1).tolist(), (x * np.array(total, np.int64 if fits else object)).sum(1).tolist()
    rest = sum(s * s for s in total)
    return [n * n * a - 2 * n * b + rest for a, b in zip(own, cross)]


def whiten(df: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row for each usable row of ``df`` and component.

    ``vec_id, component`` (from 1), ``n`` (distinct vectors), ``deviation`` (decimal: sum of
    (n x - S)^2 over the dimensions), ``whitened``, ``explained`` (share of the trace) and
    ``identity_error`` (largest entry of the whitened covariance minus the identity).

    An entry c counts as floor(scale * c), beyond a long as the nearest long. Rows whose
    vector is null, empty, or holds null or non-finite entries are left out; so are those
    of another length than most distinct vectors have (the longer, of two as frequent). A vector
    counts once for mean and covariance, however often it comes; every row is returned, with
    a null ``vec_id`` too. A component without variance has ``whitened`` null and explains
    0; without any, ``identity_error`` is 0. With fewer dimensions than ``components`` there
    are as many components as dimensions. ``deviation`` is null beyond 38 digits. Other columns
    are ignored; an empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    schema = T.StructType(
        [
            T.StructField("vec_id", df.schema[vec_id].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    fit = written(distinct_vectors(df, vector, scale), "vectors")
    most = fit.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    size = most["size"]
    fit = fit.filter(F.col("size") == size)
    n, total, matrix = scatter(fit, size)
    values, shares, vectors = principal_components(spark, n, matrix, components)
    count = len(values)
    positive = [k for k in range(count) if values[k] > 0]
    mean = np.array([float(Decimal(s) / n) for s in total])
    onto = vectors.T / np.sqrt([v if v > 0 else math.nan for v in values])

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ onto

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = whitened(unpacked(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_pydict({f"w{k}": made[:, k] for k in range(count)})

    error = 0.0
    if positive:
        w = fit.select("x").mapInArrow(fitted, ", ".join(f"w{k} double" for k in range(count)))
        pairs = [(i, j) for i in positive for j in positive if i <= j]
        got = w.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    decimals = pa.decimal128(38, 0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1), scale):
                if x.shape[1] != size:
                    continue
                away = [Decimal(s) if s < 10**38 else None for s in _squares(x, n, total)]
                rows, each = pa.array(rows), len(rows)
                made = whitened(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).take(rows)] * count),
                        pa.array(np.repeat(np.arange(1, count + 1, dtype=np.int32), each)),
                        pa.array(np.full(count * each, n, np.int64)),
                        pa.concat_arrays([pa.array(away, decimals)] * count),
                        pa.array(made.T.ravel(), mask=np.isnan(made.T.ravel())),
                        pa.array(np.repeat(shares, each)),
                        pa.array(np.full(count * each, error)),
                    ],
                    schema.names,
                )

    return df.select(vec_id, vector).mapInArrow(judge, schema)
