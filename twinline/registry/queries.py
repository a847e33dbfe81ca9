"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.columns import FEATURES, SL, SOURCE, TARGET
from twinline.config import CorpusConfig, ModelSpec
from twinline.functions.text import token_count, words
from twinline.operators import augment, clean, dedup, eda, encode, features, metrics, profile, split
from twinline.plans import corpus
from twinline.registry import views
from twinline.registry.views import SCRIPT
from twinline.session import run_dir, written
from twinline.sources import files, pairs, records, stages

Query = Callable[[SparkSession, str], DataFrame]

VOCAB = 2000
INPUT_LENGTH, TARGET_LENGTH = 48, 40
MODELS = (ModelSpec("mt5", "google/mt5-small"), ModelSpec("mbart", "facebook/mbart-large-50"))
ENCODER = "semsim_mpnet"
CONFIG = CorpusConfig(synonym_prob=0.3, swap_prob=0.5, deletion_prob=0.5, models=MODELS, vocab_size=VOCAB)
AUGMENT = {"synonym_prob": 0.3, "swap_prob": 0.5, "deletion_prob": 0.5}


def _joined(df: DataFrame) -> DataFrame:
    """Id arrays as text, so that any engine compares them alike."""
    arrays = ("input_ids", "attention_mask", "labels")
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in arrays})


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums and means of doubles, rounded: their last digits depend on row order."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})


# --- 2.1 sources, sinks, stages ------------------------------------------------


def _read_pairs(spark, sf):
    path = pairs.write_pairs_csv(views.pairs_docs(spark, sf), run_dir(spark, "csv"))
    return pairs.read_pairs(spark, path, long_ids=True)


def _dev_subset(spark, sf):
    return pairs.dev_subset(views.pairs_docs(spark, sf), 200)


def _write_parquet(spark, sf):
    return pairs.write_parquet(views.pairs_conv(spark, sf), f"{run_dir(spark, 'write')}/pairs.parquet")


def _read_parquet(spark, sf):
    path = f"{run_dir(spark, 'read')}/pairs.parquet"
    views.pairs_docs(spark, sf).write.parquet(path)
    return pairs.read_parquet(spark, path)


def _split_source(spark, sf):
    base = run_dir(spark, "splits")
    pairs.write_parquet(split.split_rows(views.unique_docs(spark, sf)), f"{base}/processed", ("split",))
    return pairs.split_source(spark, base, "train")


def _output_ready(spark, sf):
    path = f"{run_dir(spark, 'ready')}/pairs.parquet"
    before = files.output_ready(spark, path)
    written = pairs.write_parquet(views.pairs_conv(spark, sf), path)
    return written.groupBy().agg(
        F.count("*").alias("rows_written"),
        F.any_value(F.lit(before)).alias("ready_before"),
        F.any_value(F.lit(files.output_ready(spark, path))).alias("ready_after"),
    )


def _stage_control(spark, sf):
    base = run_dir(spark, "stages")
    path = f"{base}/pairs.parquet"
    written = pairs.write_parquet(views.pairs_conv(spark, sf), path)
    config, changed = CONFIG.fingerprint(), CorpusConfig().fingerprint()
    checks = {"done_before": stages.is_done(spark, base, "write", config, (path,))}
    stages.mark_done(spark, base, "write", config)
    checks["done_after"] = stages.is_done(spark, base, "write", config, (path,))
    checks["done_other_config"] = stages.is_done(spark, base, "write", changed, (path,))
    checks["done_other_output"] = stages.is_done(spark, base, "write", config, (f"{path}.missing",))
    stages.clear_stage(spark, base, "write")
    checks["done_cleared"] = stages.is_done(spark, base, "write", config, (path,))
    flags = [F.any_value(F.lit(v)).alias(k) for k, v in checks.items()]
    return written.groupBy().agg(F.count("*").alias("rows_written"), *flags)


def _json_summary_sink(spark, sf):
    path = f"{run_dir(spark, 'summary')}/raw_validation_summary.json"
    record = profile.validation_record(views.pairs_conv(spark, sf), "raw", SCRIPT)
    records.json_summary_sink(record, path)
    return _rounded(spark.read.schema(record.schema).json(path))


def _read_run_metrics(spark, sf):
    folder = records.write_run_metrics(_all_metrics(spark, sf), f"{run_dir(spark, 'metrics')}/runs")
    return _rounded(records.read_run_metrics(spark, folder).drop("semsim_bnsbert"))


def _write_run_summary(spark, sf):
    scores = metrics.text_scores(views.eval_triples(spark, sf))
    path = records.write_run_summary(scores, f"{run_dir(spark, 'summary')}/summary.csv")
    return _rounded(spark.read.option("header", True).schema(scores.schema).csv(path))


def _read_train_log(spark, sf):
    path = f"{run_dir(spark, 'log')}/train"
    views.train_log(spark, sf).withColumn("folder", F.col("run")).write.partitionBy("folder").json(path)
    return records.read_train_log(spark, path)


# --- 2.2 and 2.3 projections and filters ---------------------------------------


def _feature(name: str, column: Callable) -> Query:
    return lambda spark, sf: views.clean_docs(spark, sf).select(SL, column().alias(name))


def _token_count(spark, sf):
    return views.pairs_docs(spark, sf).select(
        SL, token_count(F.col(SOURCE)).alias("src_tokens"), token_count(F.col(TARGET)).alias("tgt_tokens")
    )


def _input_prefix(spark, sf):
    columns = [{"input": features.input_prefix(m.name)} | features.language_columns(m.name) for m in MODELS]
    return views.clean_docs(spark, sf).select(
        SL, *[column.alias(f"{m.key}_{name}") for m, own in zip(MODELS, columns) for name, column in own.items()]
    )


# --- 2.4 duplicates --------------------------------------------------------------


def _anti_join(spark, sf):
    conv = views.pairs_conv(spark, sf)
    return dedup.anti_join(conv, profile.duplicate_ids(conv))


def _near_dup(operator: Callable, min_similarity: float) -> Query:
    # These operators read their input several times.
    return lambda spark, sf: operator(written(views.unique_docs(spark, sf), "unique"), min_similarity)


# --- 2.5 profiles ------------------------------------------------------------------


def _script_match(spark, sf):
    return clean.script_match(views.pairs_docs(spark, sf), SCRIPT)


def _vocab_size_merged(spark, sf):
    """The estimate from a sketch for each split, and how it compares with the exact size."""
    rows = split.split_rows(views.unique_docs(spark, sf))
    sketches = written(eda.token_sketches(rows, ("split",)), "sketches")
    exact = eda.vocab_size(eda.token_frequency(rows)).scalar()
    near = F.abs(F.col("vocab_size") - F.col("exact")) <= 0.02 * F.col("exact")
    estimate = eda.estimated_vocab_size(sketches).withColumn("exact", exact)
    return estimate.select(F.col("exact").alias("vocab_size"), near.alias("within_2_percent"))


def _histogram(spark, sf):
    return _rounded(eda.histogram(views.featured_docs(spark, sf)), 9)


# --- 2.6 augmentation, encoding ----------------------------------------------------


def _edited(edit: Callable) -> Query:
    def query(spark, sf):
        tokens = words(F.col(SOURCE))
        return views.clean_docs(spark, sf).select(SL, F.array_join(edit(tokens, F.col(SL)), " ").alias("edited"))

    return query


def _synonym_replace(spark, sf):
    rows = views.clean_docs(spark, sf).select(SL, words(F.col(SOURCE)).alias("tokens"))
    replaced = augment.synonym_replace(rows, views.synonyms(spark), 0.3)
    return replaced.select(SL, F.array_join("tokens", " ").alias("edited"))


def _augment_text(spark, sf):
    return augment.augment_text(views.clean_docs(spark, sf), views.synonyms(spark), **AUGMENT).select(SL, SOURCE)


def _augment_train(spark, sf):
    train = split.split_rows(views.unique_docs(spark, sf)).filter("split = 'train'").drop("split")
    both = augment.augment_train(train, views.synonyms(spark), **AUGMENT)
    return both.select(SL, SOURCE, TARGET, "is_augmented")


def _vocab(spark, sf):
    return encode.build_vocab(views.clean_docs(spark, sf), VOCAB)


def _encode_pairs(spark, sf):
    return _joined(
        encode.encode_pairs(
            views.clean_docs(spark, sf),
            _vocab(spark, sf),
            features.model_prefix(MODELS[0].name),
            INPUT_LENGTH,
            TARGET_LENGTH,
        )
    )


def _encode_all(spark, sf):
    return _joined(
        encode.encode_all(
            split.split_rows(views.clean_docs(spark, sf)),
            _vocab(spark, sf),
            MODELS,
            max_input_length=INPUT_LENGTH,
            max_target_length=TARGET_LENGTH,
        )
    )


# --- 2.7 scores --------------------------------------------------------------------


def _inputs(spark, sf) -> dict:
    return {
        "models": views.models(spark),
        "token_matrices": views.token_matrices(spark, sf),
        "embeddings": {ENCODER: views.sentence_embeddings(spark, sf)},
    }


def _all_metrics(spark, sf):
    return metrics.evaluate_all(views.eval_triples(spark, sf), **_inputs(spark, sf))


def _evaluate_run(spark, sf):
    return _rounded(metrics.evaluate_run(views.eval_triples(spark, sf), "clipped", **_inputs(spark, sf)))


def _semantic_similarity(spark, sf):
    keys = ("model_key", "pair_id")
    return _rounded(metrics.semantic_similarity(*views.sentence_embeddings(spark, sf), keys, ("model_key",)))


def _greedy_match(spark, sf):
    return _rounded(metrics.greedy_match_f1(views.token_matrices(spark, sf), ("model_key",)))


def _rouge_l(tokenizer: str) -> Query:
    return lambda spark, sf: _rounded(
        metrics.rouge_l(views.eval_triples(spark, sf), ("model_key",), tokenizer)
    )


def _distinct_n(spark, sf):
    rows = views.eval_triples(spark, sf)
    one = metrics.distinct_n(rows, 1, ("model_key",))
    return _rounded(one.join(metrics.distinct_n(rows, 2, ("model_key",)), "model_key"))


def _compare_runs(spark, sf):
    return _rounded(metrics.compare_runs(_all_metrics(spark, sf), list(views.RUNS)))


# --- 2.8 whole runs ------------------------------------------------------------------


def _preprocessed(spark, sf) -> str:
    base = run_dir(spark, "corpus")
    csv = pairs.write_pairs_csv(views.pairs_docs(spark, sf), f"{base}/input.csv")
    corpus.run_preprocess(spark, csv, base, CONFIG, long_ids=True, script=SCRIPT)
    return base


def _run_preprocess(spark, sf):
    return spark.read.parquet(corpus.output(spark, _preprocessed(spark, sf), "preprocess", "processed"))


def _run_eda(spark, sf):
    stats = corpus.run_eda(spark, _preprocessed(spark, sf), CONFIG)
    listed = F.transform("top_tokens", lambda t: F.concat_ws(" ", t["token"], t["count"]))
    return _rounded(
        stats.select(
            "total_rows",
            *[f"{c}_mean" for c in eda.MEAN_COLUMNS],
            f"null_counts.{SOURCE}_nulls",
            f"null_counts.{TARGET}_nulls",
            "vocab_size",
            F.array_join(listed, ", ").alias("top_tokens"),
        )
    )


def _run_augment(spark, sf):
    rows = corpus.run_augment(spark, _preprocessed(spark, sf), views.synonyms(spark), CONFIG, SCRIPT)
    return rows.select(SL, SOURCE, TARGET, "src_len", "word_overlap", "is_augmented")


def _run_encode(spark, sf):
    rows = corpus.run_encode(spark, _preprocessed(spark, sf), CONFIG)
    return _joined(rows)


def _run_evaluate(spark, sf):
    scores = corpus.run_evaluate(
        spark, views.eval_triples(spark, sf), run_dir(spark, "scores"), CONFIG, **_inputs(spark, sf)
    )
    return _rounded(scores.drop("semsim_bnsbert"))


def _pipeline_status(spark, sf):
    return corpus.pipeline_status(spark, _preprocessed(spark, sf), CONFIG)


def _run_evaluate_each(spark, sf):
    base, inputs = run_dir(spark, "scores"), _inputs(spark, sf)
    triples = written(views.eval_triples(spark, sf), "triples")
    for model in views.RUNS:
        corpus.run_evaluate(spark, triples, base, CONFIG, model, **inputs)
    path = corpus.output(spark, base, "evaluate", "metrics/summary.csv")
    summary = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return _rounded(summary.drop("semsim_bnsbert"))


QUERIES: dict[str, Query] = {
    "read_pairs": _read_pairs,
    "dev_subset": _dev_subset,
    "write_parquet": _write_parquet,
    "read_parquet": _read_parquet,
    "split_source": _split_source,
    "output_ready": _output_ready,
    "stage_control": _stage_control,
    "json_summary_sink": _json_summary_sink,
    "read_run_metrics": _read_run_metrics,
    "write_run_summary": _write_run_summary,
    "read_train_log": _read_train_log,
    "normalize_text": lambda spark, sf: clean.normalize_text(views.pairs_docs(spark, sf)),
    "token_count": _token_count,
    "src_len": _feature("src_len", features.src_len),
    "tgt_len": _feature("tgt_len", features.tgt_len),
    "src_char_len": _feature("src_char_len", features.src_char_len),
    "tgt_char_len": _feature("tgt_char_len", features.tgt_char_len),
    "len_ratio": _feature("len_ratio", features.len_ratio),
    "word_overlap": _feature("word_overlap", features.word_overlap),
    "char_overlap": _feature("char_overlap", features.char_overlap),
    "bn_char_ratio": _feature("bn_char_ratio", lambda: features.bn_char_ratio(script=SCRIPT)),
    "add_features": lambda spark, sf: views.featured_docs(spark, sf).select(SL, *FEATURES),
    "input_prefix": _input_prefix,
    "clean_pairs": views.clean_docs,
    "drop_null_or_empty": lambda spark, sf: clean.drop_null_or_empty(views.pairs_docs(spark, sf)),
    "drop_trivial": lambda spark, sf: clean.drop_trivial(views.pairs_conv(spark, sf).union(views.pairs_docs(spark, sf))),
    "length_band": lambda spark, sf: clean.length_band(views.pairs_docs(spark, sf), 5, 40),
    "script_match": _script_match,
    "exact_dedup": views.unique_docs,
    "near_dup_lsh": _near_dup(dedup.near_dup_lsh, 0.95),
    "near_dup_exact": _near_dup(dedup.near_dup_exact, 0.95),
    "near_dup_exact_t80": _near_dup(dedup.near_dup_exact, 0.8),
    "similarity_self_join": _near_dup(dedup.similarity_self_join, 0.8),
    "anti_join": _anti_join,
    "deduplicate": lambda spark, sf: dedup.deduplicate(views.clean_docs(spark, sf), "exact", 0.95),
    "profile": lambda spark, sf: profile.profile(views.pairs_conv(spark, sf), SCRIPT),
    "null_counts": lambda spark, sf: profile.null_counts(views.pairs_docs(spark, sf)),
    "duplicate_ids": lambda spark, sf: profile.duplicate_ids(views.pairs_conv(spark, sf)),
    "script_coverage": lambda spark, sf: _rounded(profile.script_coverage(views.pairs_docs(spark, sf), SCRIPT)),
    "validate_raw": lambda spark, sf: profile.validate_raw(views.pairs_docs(spark, sf), SCRIPT),
    "validate_clean": lambda spark, sf: profile.validate_clean(views.unique_docs(spark, sf), SCRIPT),
    "eda_summary": lambda spark, sf: _rounded(eda.eda_summary(views.featured_docs(spark, sf))),
    "numeric_sample": lambda spark, sf: eda.numeric_sample(views.featured_docs(spark, sf), "len_ratio", 0.25),
    "token_frequency": lambda spark, sf: eda.token_frequency(views.unique_docs(spark, sf)),
    "top_tokens": lambda spark, sf: eda.top_tokens(eda.token_frequency(views.unique_docs(spark, sf))),
    "vocab_size": lambda spark, sf: eda.vocab_size(eda.token_frequency(views.unique_docs(spark, sf))),
    "vocab_size_merged": _vocab_size_merged,
    "histogram": _histogram,
    "split_counts": lambda spark, sf: split.split_counts(split.split_rows(views.unique_docs(spark, sf))),
    "before_after_counts": lambda spark, sf: profile.before_after_counts(views.pairs_docs(spark, sf)),
    "split_rows": lambda spark, sf: split.split_rows(views.unique_docs(spark, sf)).select(SL, "split"),
    "augment_text": _augment_text,
    "synonym_replace": _synonym_replace,
    "adjacent_swap": _edited(lambda tokens, key: augment.adjacent_swap(tokens, key, 0.5)),
    "random_delete": _edited(lambda tokens, key: augment.random_delete(tokens, key, 0.5)),
    "augment_train": _augment_train,
    "build_vocab": _vocab,
    "encode_pairs": _encode_pairs,
    "encode_all": _encode_all,
    "bleu": lambda spark, sf: _rounded(metrics.bleu(views.eval_triples(spark, sf), ("model_key",))),
    "rouge_l": _rouge_l("unicode"),
    "rouge_l_ascii": _rouge_l("ascii"),
    "distinct_n": _distinct_n,
    "semantic_similarity": _semantic_similarity,
    "greedy_match_f1": _greedy_match,
    "evaluate_run": _evaluate_run,
    "evaluate_all": lambda spark, sf: _rounded(_all_metrics(spark, sf)),
    "compare_runs": _compare_runs,
    "loss_curve": lambda spark, sf: metrics.loss_curve(views.train_log(spark, sf)),
    "run_preprocess": _run_preprocess,
    "run_eda": _run_eda,
    "run_augment": _run_augment,
    "run_encode": _run_encode,
    "run_evaluate": _run_evaluate,
    "run_evaluate_each": _run_evaluate_each,
    "pipeline_status": _pipeline_status,
}
