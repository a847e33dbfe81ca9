"""Reading and writing pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from twinline.columns import ID, SL, SOURCE, TARGET
from twinline.sources.files import exists, output_ready
from twinline.sources.split_csv import read_split_csv
from twinline.sources.stages import STAGES, located, require_sound, stage_record

CORRUPT = "_corrupt_record"


def pair_schema(long_ids: bool = False, corrupt: bool = False) -> StructType:
    """The four columns; 64-bit ids for tables of more than 2^31 rows."""
    number = LongType() if long_ids else IntegerType()
    fields = [
        StructField(SL, number, True),
        StructField(ID, number, True),
        StructField(SOURCE, StringType(), True),
        StructField(TARGET, StringType(), True),
    ]
    if corrupt:
        fields.append(StructField(CORRUPT, StringType(), True))
    return StructType(fields)


def read_pairs(
    spark: SparkSession,
    path: str,
    long_ids: bool = False,
    multi_line: bool = False,
    corrupt: bool = False,
) -> DataFrame:
    """Pairs from CSV with a header, UTF-8, schema declared.

    A malformed number becomes null; ``corrupt`` keeps the offending line in
    ``_corrupt_record``. ``multi_line`` allows line breaks inside quotes; the lines are
    then read twice, still by a task for each split (:mod:`twinline.sources.split_csv`).
    """
    if "*" not in path and not exists(spark, path):
        raise FileNotFoundError(f"there is no pair file at {path}")
    if multi_line:
        return read_split_csv(spark, path, pair_schema(long_ids, corrupt), CORRUPT)
    return (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(pair_schema(long_ids, corrupt))
        .csv(path)
    )


def write_pairs_csv(df: DataFrame, path: str) -> str:
    """Pairs as CSV that :func:`read_pairs` reads back unchanged."""
    (
        df.select(SL, ID, SOURCE, TARGET)
        .write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def spread(df: DataFrame, few: int = 8) -> DataFrame:
    """Deal a small table over the cores if it was read in fewer than ``few`` tasks.

    A parquet row group is one task however many cores there are. A large table
    has more splits than ``few`` and is left where it is.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, 64)
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(few, cores) else df


def dev_subset(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``sl`` and ``id``, or all if ``n`` is None."""
    return df if n is None else df.orderBy(SL, ID).limit(n)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Overwrite ``path`` and go on from what was written."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"Table not found: {path}")
    return spark.read.parquet(path)


def split_source(
    spark: SparkSession, base: str, split: str, use_augmented_train: bool = False
) -> DataFrame:
    """One split; for ``train`` the augmented one if asked for.

    Tables are those of the runs in force, or lie in ``processed`` and ``augmented`` if
    they were put there by hand. Asking for augmented rows that are not there is an error,
    not a silent return to the plain ones, and so is asking for rows that were augmented from
    an earlier preprocess run.
    """
    if split == "train" and use_augmented_train:
        path = located(spark, base, "augmentation", "augmented/train.parquet")
        if not output_ready(spark, path):
            raise FileNotFoundError(f"Augmented train split not found or unfinished: {path}")
        if stage_record(spark, f"{base}/{STAGES}", "augmentation"):
            require_sound(spark, base, "augmentation")
        return spark.read.parquet(path)
    path = located(spark, base, "preprocess", "processed")
    if not output_ready(spark, path):
        raise FileNotFoundError(f"Splits not found or unfinished: {path}")
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")
