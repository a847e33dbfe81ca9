"""Small result files: summaries, metrics per run, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from twinline.operators.metrics import METRICS, loss_curve
from twinline.sources.files import exists

METRIC_SCHEMA = StructType(
    [StructField("model_key", StringType()), StructField("model_name", StringType())]
    + [StructField(m, DoubleType()) for m in METRICS]
)


def json_summary_sink(record: DataFrame, path: str) -> str:
    """A one-row frame as one JSON file, null fields included."""
    record.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_run_metrics(metrics: DataFrame, folder: str) -> str:
    """One JSON file per model below ``folder``."""
    per_model = metrics.withColumn("run", F.col("model_key")).repartition("run")
    per_model.write.mode("overwrite").partitionBy("run").json(folder)
    return folder


def read_run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All runs' metrics; a metric that a run lacks is null.

    Files named ``summary`` are not runs.
    """
    rows = (
        spark.read.schema(METRIC_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
    )
    return rows.filter(~F.col("_metadata.file_name").startswith("summary."))


def write_run_summary(metrics: DataFrame, path: str) -> str:
    """One CSV row per model, with header."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """Loss per run and step from JSON lines, one folder ``run=...`` per run."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Training log not found: {path}")
    return loss_curve(spark.read.schema("run string, step bigint, loss double").json(path))
