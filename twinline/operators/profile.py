"""Counts that describe a pair table, and the gates built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.columns import ID, SOURCE, TARGET
from twinline.functions.text import BENGALI, has_script
from twinline.operators.clean import is_clean, of_normalized
from twinline.operators.dedup import pair_hash


def null_counts(df: DataFrame, columns=(SOURCE, TARGET, ID)) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def duplicate_ids(df: DataFrame, id_column: str = ID) -> DataFrame:
    """Ids that occur more than once; a null id counts as a value."""
    return df.groupBy(id_column).agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def script_coverage(df: DataFrame, script: str = BENGALI, column: str = SOURCE) -> DataFrame:
    """Share of rows with a character of the script; 0 on an empty table."""
    hit = F.when(has_script(F.col(column), script), 1.0).otherwise(0.0)
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("script_coverage"))


def profile(df: DataFrame, script: str = BENGALI) -> DataFrame:
    """Row, null and duplicate-id counts and script coverage as one row.

    One scan: rows are counted per id first, because repeated ids need it, and
    the other counts are sums over the same groups. The grouping combines on the
    map side, so a frequent id costs one row per task.
    """
    per_id = df.groupBy(ID).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(SOURCE).isNull()).alias("no_source"),
        F.count_if(F.col(TARGET).isNull()).alias("no_target"),
        F.count_if(has_script(F.col(SOURCE), script)).alias("in_script"),
    )

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    return per_id.agg(
        total("n").alias("total_rows"),
        total("no_source").alias(f"{SOURCE}_nulls"),
        total("no_target").alias(f"{TARGET}_nulls"),
        total(F.when(F.col(ID).isNull(), F.col("n")).otherwise(0)).alias(f"{ID}_nulls"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.when(total("n") > 0, total("in_script") / total("n")).otherwise(0.0).alias("script_coverage"),
    )


def validation_record(df: DataFrame, stage: str, script: str = BENGALI) -> DataFrame:
    """The profile with its stage and verdict."""
    if stage not in ("raw", "clean"):
        raise ValueError(f"unknown stage: {stage}")
    valid = F.col("total_rows") > 0
    if stage == "clean":
        valid = valid & (F.col(f"{SOURCE}_nulls") == 0) & (F.col(f"{TARGET}_nulls") == 0)
    return profile(df, script).withColumns({"stage": F.lit(stage), "valid": valid})


def require_valid(record: DataFrame) -> DataFrame:
    """Raise unless the one-row record says valid, else hand it back."""
    row = record.first()
    if not row["valid"]:
        raise ValueError(f"{row['stage']} pairs failed validation: {row.asDict()}")
    return record.sparkSession.createDataFrame([row], record.schema)


def validate_raw(df: DataFrame, script: str = BENGALI) -> DataFrame:
    return require_valid(validation_record(df, "raw", script))


def validate_clean(df: DataFrame, script: str = BENGALI) -> DataFrame:
    return require_valid(validation_record(df, "clean", script))


def before_after_counts(df: DataFrame, min_tokens: int = 3, max_tokens: int = 256) -> DataFrame:
    """Rows before cleaning, after cleaning and after exact deduplication.

    One scan and one shuffle of hashes: a row that cleaning drops has no hash, and all of
    these are one group, which tasks count before the shuffle. Counts are of the data, not
    of what tasks have seen, so a task that is run again counts nothing twice.
    """
    pair = of_normalized(lambda s, t: F.when(is_clean(s, t, min_tokens, max_tokens), pair_hash(s, t)))
    per_pair = df.select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    clean = F.sum(F.when(F.col("pair").isNotNull(), F.col("n")))
    return per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before_clean"),
        F.coalesce(clean, F.lit(0)).alias("after_clean"),
        F.count("pair").alias("after_dedup"),
    )
