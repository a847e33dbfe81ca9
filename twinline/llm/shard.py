"""Sharding by jump consistent hashing, without a ring table.

A key jumps from shard to shard of a growing list; where it stands before the first
jump beyond the end is its shard. With one more shard, a key stays or moves to the new
one, and the share that moves is the new shard's share. Only DataFrame functions are
used; a shard is a projection, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the published generator, as 16-bit and 32-bit limbs.
MULTIPLIER = 2862933555777941757
LOW16, MID16, HIGH32 = MULTIPLIER & 0xFFFF, MULTIPLIER >> 16 & 0xFFFF, MULTIPLIER >> 32
MASK32 = 0xFFFFFFFF

# Pieces into which a shard's rows are hashed for numbering.
SLOT_RANGES = 4096


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * MULTIPLIER + 1 modulo 2^64, in limbs that never overflow 64 bits."""
    a, b = low * F.lit(LOW16), low * F.lit(MID16)
    sum_low = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    c, d = high * F.lit(LOW16), high * F.lit(MID16)
    sum_high = (
        F.shiftright(sum_low, 32)
        + F.shiftright(b, 16)
        + (low * F.lit(HIGH32)).bitwiseAND(F.lit(MASK32))
        + c
        + F.shiftleft(d.bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return sum_high.bitwiseAND(F.lit(MASK32)), sum_low.bitwiseAND(F.lit(MASK32))


def jump(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown_shard`` among one more.

    The key is mixed by xxhash64 first. A jump goes ahead by at least one, so the fold
    over as many steps as shards is enough; steps behind the end change nothing.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    long = "bigint"
    mixed = F.xxhash64(key)
    start = F.struct(
        F.shiftrightunsigned(mixed, 32).cast(long).alias("high"),
        mixed.bitwiseAND(F.lit(MASK32)).cast(long).alias("low"),
        F.lit(0).cast(long).alias("at"),
        F.lit(0).cast(long).alias("shard"),
        F.lit(0).cast(long).alias("grown_shard"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        draw = F.shiftright(high, 1) + F.lit(1)
        ahead = F.floor((state["at"] + F.lit(1)) * (F.lit(2147483648.0) / draw)).cast(long)
        inside = state["at"] <= F.lit(shards)
        return F.struct(
            high.cast(long).alias("high"),
            low.cast(long).alias("low"),
            F.when(inside, ahead).otherwise(state["at"]).alias("at"),
            F.when(state["at"] < F.lit(shards), state["at"]).otherwise(state["shard"]).alias("shard"),
            F.when(inside, state["at"]).otherwise(state["grown_shard"]).alias("grown_shard"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards + 1)),
        start,
        step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown_shard"].cast("int").alias("grown_shard")),
    )


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard``; columns of these names are replaced.

    Equal keys share a shard; a null key is a key like any other. No shuffle.
    """
    kept = [c for c in df.columns if c not in ("shard", "grown_shard", "_jump")]
    return df.withColumn("_jump", jump(F.col(key), shards)).select(*kept, "_jump.shard", "_jump.grown_shard")


def number_slots(df: DataFrame, ranges: int = SLOT_RANGES) -> DataFrame:
    """``df``, which has ``shard``, with ``slot``: gapless numbers from 0 in each shard.

    No task sorts a shard: rows are hashed into ``ranges`` pieces of each shard and
    numbered within them, and the pieces' sizes (``ranges`` rows a shard) are summed up.
    Rows equal in all columns are counted before the shuffle and told apart after it.
    """
    columns = df.columns
    rows = (
        df.groupBy(*columns)
        .agg(F.count("*").alias("_copies"))
        .withColumn("_range", F.pmod(F.xxhash64(*columns), F.lit(ranges)).cast("int"))
    )
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.groupBy("shard", "_range")
        .agg(F.sum("_copies").alias("_size"))
        .select("shard", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    )
    ahead = Window.partitionBy("shard", "_range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_ahead", F.coalesce(F.sum("_copies").over(ahead), F.lit(0)))
        .join(pieces, ["shard", "_range"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select(*columns, (F.col("_first") + F.col("_ahead") + F.col("_copy")).alias("slot"))
    )


def shard_table(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", ranges: int = SLOT_RANGES
) -> DataFrame:
    """Key, size (bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.

    A null text counts as an empty one. Repeated rows get a slot each; an empty table
    gives an empty one; other columns of ``docs`` are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    numbered = number_slots(assign_shards(rows, key, shards), ranges)
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
