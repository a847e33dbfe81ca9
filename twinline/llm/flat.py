"""Texts of an Arrow batch as flat numpy arrays, and hashes over them."""

from __future__ import annotations

import ctypes
import gc
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Bytes of text that are hashed at once (a longer text is taken alone). Hashing holds some hundred bytes
# for each of them, and one less than a power of two keeps the tables of powers at 4 MB.
CHUNK_BYTES = (1 << 18) - 1

# Odd multipliers and the finishing steps of a public 64-bit mixer.
MULTIPLY_1, MULTIPLY_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15

UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Return memory that a worker no longer uses to the machine.

    A worker is used for task after task. Both allocators keep what a task has freed, so its
    peak would stay reserved while other operators, or the JVM beside it, need the memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable) -> Callable:
    """A function of a task's batches, or of a group, that gives back memory when it is done."""
    if inspect.isgeneratorfunction(function):

        def run(batches):
            try:
                yield from function(batches)
            finally:
                give_back()

    else:

        def run(table):
            try:
                return function(table)
            finally:
                give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit number for each of ``x``, as if drawn at random."""
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * MULTIPLY_1
    x = (x ^ (x >> np.uint64(27))) * MULTIPLY_2
    return x ^ (x >> np.uint64(31))


BYTE_DRAW = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


# The longest tables so far, which a worker keeps: 16 bytes for each place.
_longest: list[tuple[np.ndarray, np.ndarray]] = []


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, ``length`` of them at least."""
    if not _longest or len(_longest[0][0]) < length:
        base, both = GOLDEN | 1, []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(1 << 18, 1 << max(0, length - 1).bit_length()), b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _longest[:] = [tuple(both)]
    return _longest[0]


def span_hash(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each ``values[start:stop]`` that doesn't depend on where it stands."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts or binaries, and where each row's begin; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes (CHUNK_BYTES)."""
    data, offsets = flat(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (size or CHUNK_BYTES), "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """Words (runs without ASCII white space) of flat texts: hash, row, start and stop byte."""
    if lower:
        data = UPPER_TO_LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return span_hash(BYTE_DRAW[data], starts, stops), rows, starts, stops


def buckets(df: DataFrame) -> int:
    """Groups into which keys are dealt: a few for each shuffle partition of the session."""
    return 3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def run_lengths(first: np.ndarray, total: int) -> np.ndarray:
    """How long the runs are that begin at ``first``, of ``total`` values."""
    return np.diff(first, append=total)


def dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with its part of the columns, packed."""
    order = np.argsort(bucket, kind="stable")
    first = runs(bucket[order])
    last = [*first[1:].tolist(), len(order)]
    packed = {name: [values[order[a:b]].tobytes() for a, b in zip(first, last)] for name, values in columns.items()}
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(bucket[order][first], pa.int32()), **{n: pa.array(v, pa.binary()) for n, v in packed.items()}}
    )


def unpacked(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    """A packed column of all rows of a group, in one array."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)
