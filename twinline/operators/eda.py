"""Exploratory statistics of a featured pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.columns import SL, SOURCE, TARGET
from twinline.functions.text import ASCII_SPACE, uniform
from twinline.operators.profile import null_counts

MEAN_COLUMNS = ("src_len", "tgt_len", "len_ratio", "word_overlap")


def eda_summary(df: DataFrame, columns=MEAN_COLUMNS) -> DataFrame:
    """Row count and means as one row; nulls are left out, no values give 0."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean") for c in columns]
    return df.agg(F.count("*").alias("total_rows"), *means)


def numeric_sample(
    df: DataFrame, column: str, fraction: float = 1.0, seed: int = 42, key: str = SL
) -> DataFrame:
    """Non-null values of a column as doubles, sampled by a hash of ``key``.

    Unlike ``DataFrame.sample`` the choice does not depend on partitioning.
    """
    if fraction < 1.0:
        df = df.filter(uniform(seed, F.col(key), "sample") < fraction)
    return df.select(F.col(column).cast("double").alias("value")).dropna()


def _tokens_of(df: DataFrame, by: tuple[str, ...], columns) -> DataFrame:
    tokens = F.flatten(F.array_compact(F.array(*[F.split(c, ASCII_SPACE) for c in columns])))
    return df.select(*by, F.explode(tokens).alias("token"))


def token_frequency(df: DataFrame, columns=(SOURCE,)) -> DataFrame:
    """Occurrences of each token; case is kept, text is split untrimmed."""
    return _tokens_of(df, (), columns).groupBy("token").agg(F.count("*").alias("count"))


def top_tokens(frequency: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent tokens, ties by token."""
    return frequency.orderBy(F.desc("count"), "token").limit(k)


def vocab_size(frequency: DataFrame) -> DataFrame:
    return frequency.agg(F.count("*").alias("vocab_size"))


# Log 2 of a sketch's registers: some 0.4 % of error for one of 32 kB.
SKETCH_BITS = 16


def token_sketches(df: DataFrame, by: tuple[str, ...] = (), columns=(SOURCE,)) -> DataFrame:
    """``(*by, sketch)``: a sketch of the distinct tokens of each group, some 32 kB however many there are.

    Kept beside a table, it is merged with those of other tables or days
    (:func:`merged_sketch`), and no token is counted or shuffled again.
    """
    return _tokens_of(df, by, columns).groupBy(*by).agg(F.hll_sketch_agg("token", SKETCH_BITS).alias("sketch"))


def merged_sketch(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One sketch of all tokens that the given ones have seen, for each group of ``by``."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_vocab_size(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``vocab_size`` from sketches, merged; 0 without any."""
    size = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    return merged_sketch(sketches, by).select(*by, size.alias("vocab_size"))


def histogram(df: DataFrame, columns=MEAN_COLUMNS, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum for each column.

    Rows are ``(column, bin, bin_low, bin_high, count)``, empty bins included.
    The last bin is closed. If all values are equal, the range is the value plus
    and minus one half.
    """
    values = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    long = df.select(values.alias("v")).select("v.column", "v.value").dropna()
    # One row per column name: bounded by the number of columns asked for.
    limits = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(
        "column",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins

    def edge(i):
        return F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * width)

    # Division may land a value one bin off its edges; the edges decide.
    guess = F.least(F.floor((F.col("value") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    placed = (
        long.join(F.broadcast(limits), "column")
        .withColumn("bin", guess)
        .withColumn(
            "bin",
            F.when(F.col("value") < edge(F.col("bin")), F.col("bin") - 1)
            .when((F.col("bin") < bins - 1) & (F.col("value") >= edge(F.col("bin") + 1)), F.col("bin") + 1)
            .otherwise(F.col("bin")),
        )
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(placed, ["column", "bin"], "left").select(
        "column",
        "bin",
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + 1).alias("bin_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def eda_record(df: DataFrame, k: int = 50) -> DataFrame:
    """Summary, null counts, vocabulary size and top tokens as one row."""
    frequency = token_frequency(df)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("rank"), "token")))
    top = top_tokens(frequency, k).agg(
        F.transform(ranked, lambda e: F.struct(e["token"].alias("token"), (-e["rank"]).alias("count")))
    )
    return eda_summary(df).select(
        "*",
        null_counts(df, (SOURCE, TARGET)).select(F.struct("*")).scalar().alias("null_counts"),
        vocab_size(frequency).scalar().alias("vocab_size"),
        top.scalar().alias("top_tokens"),
    )
