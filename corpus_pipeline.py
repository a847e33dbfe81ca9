"""The corpus pipeline: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and returns
a DataFrame of the same columns; the last returns what training reads. Each is written
as Parquet and read again before the next. A stage runs its operator over the documents
it is given and acts on what the operator says; a document without an id takes part in
no pair and is kept by the stages that compare documents with each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from twinline.llm.queries import tokenizer_path
from twinline.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
GRAM_WORDS, SIMILAR_PERCENT = 5, 80
# Sets that one search holds in its index, some 40 MB with what it takes to build it; a larger
# component is searched in pieces. It steers memory alone.
INDEX_SETS = 2_000
REPEATED_BYTES = 100


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    field = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, field).filter("score < 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word n-grams connect, the smallest doc_id stays.

    Equal rows of a document that stays are copies of it: one stays. Rows that share an id and
    differ in text are one document, so all its texts stay.
    """
    classes = ngram_join.similar_documents(docs, GRAM_WORDS, SIMILAR_PERCENT, index_sets=INDEX_SETS)
    gone = classes.filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    known = kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return known.union(kept.filter("doc_id is null")).select(*COLUMNS)


def repeated_bytes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that are found earlier go; a document that loses all of them goes too.

    A character of which a byte is cut goes as a whole. n_chars is counted anew.
    """
    cut = suffix_dedup.remove_repeats(docs, REPEATED_BYTES)
    left = suffix_dedup.whole_characters("kept")
    changed = F.col("n_removed") > 0
    return (
        cut.withColumn("text", F.when(changed, left).otherwise(F.col("text")))
        .filter(~changed | (F.length("text") > 0))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    A row is known by a hash of its id and text, so rows without an id and those that share
    one are told apart.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    leaked = decontaminate.leaks(rows.select(F.col("_row").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_row"))
    return rows.join(leaked.distinct(), "_row", "left_anti").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests that tell whether decoding gives it back."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), tokenizer_path())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_bytes_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

# SQL can express neither the trained scores nor the tokenizer; tests/llm compares the
# stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
