"""One registered query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm import (
    align, bpe, decontaminate, html_text, multi_index, ngram_join, recompress, shard, simhash, suffix_dedup, toxicity, url_filter, whiten,
)

# The host and path of each rule, and what it says.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary; TWINLINE_TOKENIZER names another file."""
    if "TWINLINE_TOKENIZER" in os.environ:
        return os.environ["TWINLINE_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The vocabulary of pieces; TWINLINE_PIECES names another file."""
    if "TWINLINE_PIECES" in os.environ:
        return os.environ["TWINLINE_PIECES"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_table(table(spark, sf_dir, "documents"), 16)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.remove_repeats(docs, 100))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(recompress.remove_repeated_words(table(spark, sf_dir, "documents"), 50))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), 4, 85)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 4)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten.whiten(table(spark, sf_dir, "embeddings"), 4)
    # Beyond a long there is no such number.
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    return rows.withColumn("groups_sha256", digest).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

_URL_PARTS = """
SELECT page_id,
       CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
FROM pages
"""
_URL_ROWS = f"""
SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM ({_URL_PARTS})
"""
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
urls AS ({_URL_ROWS}),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM urls)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (host, path)
""",
}
