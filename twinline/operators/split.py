"""Reproducible train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.columns import SOURCE, TARGET
from twinline.functions.text import uniform

SPLITS = ("train", "val", "test")


def split_rows(
    df: DataFrame,
    train: float = 0.8,
    validation: float = 0.1,
    seed: int = 42,
    key: Column | None = None,
) -> DataFrame:
    """Add a ``split`` column drawn by a hash of seed and key.

    The key defaults to the pair's two texts. Any partitioning gives the same
    split; ``key=F.col("source_sentence")`` keeps all paraphrases of a source in
    one split.
    """
    if key is None:
        key = F.concat_ws("||", SOURCE, TARGET)
    draw = uniform(seed, key, "split")
    return df.withColumn("_draw", draw).select(
        *df.columns,
        F.when(F.col("_draw") < train, "train")
        .when(F.col("_draw") < train + validation, "val")
        .otherwise("test")
        .alias("split"),
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("count"))
