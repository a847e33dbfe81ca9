"""Pair tables and scoring inputs that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.columns import ID, SL, SOURCE, TARGET
from twinline.operators.clean import clean_pairs
from twinline.operators.dedup import exact_dedup
from twinline.operators.features import add_features
from twinline.sources.pairs import spread

# The given texts are in Latin script: letters with diacritics stand in for it.
SCRIPT = r"[À-ɏ]"

# A document or conversation has fewer lines or turns than this, so numbers made of both
# never clash.
LINES = 1 << 32

# Prediction runs made from the pairs, and how far apart their embeddings lie.
RUNS = {"copy_source": 1, "clipped": 2}

# A made-up synonym table of frequent tokens.
SYNONYMS = {
    "and": ["plus", "also"],
    "de": ["du", "des", "d'un"],
    "der": ["dieser", "jener"],
    "la": ["cette"],
    "le": ["ce", "cet"],
    "of": ["from"],
    "that": ["which", "this"],
    "the": ["a", "this", "that"],
    "und": ["sowie"],
    "with": ["using", "by"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pairs_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of every document, paired off: first and second, third and fourth..."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("lines") - 1, F.lit(2)),
        lambda i: F.struct(
            F.nullif(F.get("lines", i), F.lit("")).alias(SOURCE),
            F.nullif(F.get("lines", i + 1), F.lit("")).alias(TARGET),
        ),
    )
    number = F.col("doc_id") * LINES + F.col("pos")
    return docs.select("doc_id", F.posexplode(pairs).alias("pos", "p")).select(
        number.alias(SL), number.alias(ID), f"p.{SOURCE}", f"p.{TARGET}"
    )


def pairs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it; the conversation is the id."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias(SOURCE))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias(TARGET)
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        (F.col("conv_id") * LINES + F.col("turn")).alias(SL), F.col("conv_id").alias(ID), SOURCE, TARGET
    )


def clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pairs(pairs_docs(spark, sf_dir))


def unique_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(clean_docs(spark, sf_dir))


def featured_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(unique_docs(spark, sf_dir), script=SCRIPT)


def eval_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: one predicts the source itself, one the target less its last token."""
    predictions = F.array(
        F.struct(F.lit("copy_source").alias("model_key"), F.col(SOURCE).alias("prediction")),
        F.struct(
            F.lit("clipped").alias("model_key"), F.regexp_replace(TARGET, r" [^ ]*$", "").alias("prediction")
        ),
    )
    return unique_docs(spark, sf_dir).select(
        F.inline(predictions),
        ID,
        F.col(SOURCE).alias("source"),
        F.col(TARGET).alias("reference"),
    )


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, f"{m}-run") for m in RUNS], "model_key string, model_name string")


def sentence_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vector i as source and, for each run, vector i + offset as its prediction."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def keyed(shift: int) -> DataFrame:
        keys = [
            F.struct(F.lit(m).alias("model_key"), (F.col("vec_id") - shift * offset).alias("pair_id"))
            for m, offset in RUNS.items()
        ]
        return vectors.select(F.inline(F.array(*keys)), "embedding")

    return keyed(0), keyed(1)


def token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector cut into 8 token vectors of 8 numbers; the pairs are as above."""
    references, predictions = sentence_embeddings(spark, sf_dir)

    def rows(column: str):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(column, i * 8 + 1, 8))

    keys = ["model_key", "pair_id"]
    return references.select(*keys, rows("embedding").alias("reference_tokens")).join(
        predictions.select(*keys, rows("embedding").alias("prediction_tokens")), keys
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as training logs: a run per type; ``error`` logs no loss."""
    loss = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), loss.alias("loss")
    )


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYNONYMS.items()), "token string, alternatives array<string>")
