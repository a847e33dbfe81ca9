"""The k largest of a table, without gathering k rows of every task in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading bits of a count that its group in the histogram keeps.
COARSE_BITS = 10
# Rows of one range that are sorted in one task, ranges it is parted into while it has more,
# and rows looked at to find where to part it.
FEW_ROWS, RANGES, LOOKED_AT = 65_536, 64, 4096


def _group(count: Column) -> Column:
    """A number that grows with ``count`` and takes some fifty thousand values at most."""
    shift = F.greatest(F.length(F.bin(count)) - (COARSE_BITS + 1), F.lit(0))
    return (shift * (2 << COARSE_BITS) + F.call_function("shiftright", count, shift)).cast("int")


def _pivots(rows: DataFrame, n: int) -> list[tuple[int, str]]:
    """Rows that part ``n`` rows, in order, into about RANGES equal ranges.

    They are drawn by hash, about LOOKED_AT of them, so what is fetched doesn't grow.
    """
    share = int(min(1.0, LOOKED_AT / n) * (1 << 31))
    drawn = rows.filter(F.pmod(F.xxhash64("count", "token"), F.lit(1 << 31)) < share)
    seen = sorted((-r["count"], r["token"]) for r in drawn.select("count", "token").collect())
    step = max(1, len(seen) // RANGES)
    return [(-negative, token) for negative, token in seen[step::step]]


def top_counts(counted: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``(token, count)`` with the largest counts, ties by token; counts are positive.

    A histogram of the counts names the group in which the k-th largest is. All above it
    belong to the answer. A group of more than FEW_ROWS rows, such as the tokens that occur
    once, is parted by some of its rows, and the parts are counted, until the part in which
    the k-th row is has few rows. Only that is sorted; no task reads more than it.

    ``counted`` is read several times, so it should be a written table.
    """
    if k <= 0:
        return counted.limit(0)
    grouped = counted.groupBy(_group(F.col("count")).alias("group")).agg(F.count("*").alias("n"))
    sizes = sorted(((r["group"], r["n"]) for r in grouped.collect()), reverse=True)
    left, at = k, 0
    while at < len(sizes) and sizes[at][1] <= left:
        left -= sizes[at][1]
        at += 1
    if at == len(sizes):
        return counted
    group, n = sizes[at]
    taken = [counted.filter(_group(F.col("count")) > group)]
    rest = counted.filter(_group(F.col("count")) == group)

    def before(row: tuple[int, str]) -> Column:
        return (F.col("count") > row[0]) | ((F.col("count") == row[0]) & (F.col("token") < row[1]))

    while left and n > FEW_ROWS:
        pivots = _pivots(rest, n)
        place = reduce(lambda found, p: found.when(before(p[1]), p[0]), list(enumerate(pivots))[1:], F.when(before(pivots[0]), 0))
        parts = rest.withColumn("_part", place.otherwise(len(pivots)))
        counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
        part = 0
        while counts.get(part, 0) <= left and part < len(pivots):
            left -= counts.get(part, 0)
            part += 1
        if part:
            taken.append(rest.filter(before(pivots[part - 1])))
        low = ~before(pivots[part - 1]) if part else F.lit(True)
        high = before(pivots[part]) if part < len(pivots) else F.lit(True)
        rest, n = rest.filter(low & high), counts.get(part, 0)
    if left:
        taken.append(rest.orderBy(F.desc("count"), "token").limit(left))
    return reduce(DataFrame.union, taken)
