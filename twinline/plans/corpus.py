"""The corpus run: preprocess, explore, augment, encode, evaluate.

Stages build on each other (:func:`needs`). Below one ``base`` folder, each run of a stage has
a folder of its own, named in the stage's record once it is finished:

    preprocess/<run>      raw/raw.parquet, interim/featured.parquet, processed (by split), reports
    eda_report/<run>      reports
    augmentation/<run>    augmented/train.parquet
    encode/<run>          interim/vocab.parquet, encoded (by model and split)
    scores/<run>          metrics of all models scored so far
    stages                the records

So a run that dies leaves what was there before, whole and in force. :func:`output` tells
where something is.

A stage is skipped if its record has the fingerprint that it would be run with: the
settings, the arguments, the input files with their lengths and times, and the records of
the stages before it, and if those are sound, back to the first. A stage that would be
built on one that isn't sound is refused (:class:`StaleStage`). Tables that are given as
DataFrames count by the identity that the caller gives them (``inputs_id``); without
one, the stage always runs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinline.columns import ID, SL, SOURCE, TARGET
from twinline.config import CorpusConfig
from twinline.functions.text import BENGALI
from twinline.operators.augment import augment_train
from twinline.operators.clean import clean_pairs, is_clean, of_normalized
from twinline.operators.dedup import deduplicate
from twinline.operators.eda import eda_record, histogram
from twinline.operators.encode import build_vocab, encode_all
from twinline.operators.features import add_features
from twinline.operators.metrics import evaluate_all, evaluate_run
from twinline.operators.profile import require_valid, validation_record
from twinline.operators.split import SPLITS, split_rows
from twinline.sources.files import delete, exists, listing, output_ready
from twinline.sources.pairs import CORRUPT, dev_subset, read_pairs, split_source, write_parquet
from twinline.sources.records import json_summary_sink, read_run_metrics, write_run_metrics, write_run_summary
from twinline.sources.stages import STAGES, identity, is_done, located, new_run, publish, require_sound, sound, stage_record


# What each stage leaves behind.
OUTPUTS = {
    "preprocess": ("interim/featured.parquet", "processed"),
    "eda_report": ("reports/eda_stats.json", "reports/histogram.json"),
    "augmentation": ("augmented/train.parquet",),
    "encode": ("encoded",),
    "evaluate": ("metrics/runs", "metrics/summary.csv"),
}
# The stage whose runs hold the scores of all models, whichever stage has scored them.
SCORES = "scores"


def needs(stage: str, config: CorpusConfig) -> tuple[str, ...]:
    """The stages that a stage reads from."""
    if stage == "encode" and config.use_augmented_train:
        return ("preprocess", "augmentation")
    return ("preprocess",) if stage in ("eda_report", "augmentation", "encode") else ()


def _holder(stage: str) -> str:
    return SCORES if stage == "evaluate" or stage.startswith("evaluate_") else stage


def output(spark: SparkSession, base: str, stage: str, artifact: str) -> str:
    """The path of an output of the run in force of a stage."""
    return located(spark, base, _holder(stage), artifact)


def _artifacts(spark: SparkSession, base: str, stage: str) -> tuple[str, ...]:
    if stage.startswith("evaluate_"):
        return (output(spark, base, stage, f"metrics/runs/run={stage.removeprefix('evaluate_')}"),)
    return tuple(output(spark, base, stage, a) for a in OUTPUTS[stage])


def _fingerprint(spark: SparkSession, base: str, stage: str, config: CorpusConfig, args: dict) -> str | None:
    """What the stage would be recorded under, or None if an input has no identity or isn't sound."""
    if "inputs_id" in args and args["inputs_id"] is None:
        return None
    parts = [config.fingerprint(), args, [listing(spark, p) for p in args.get("paths", ())]]
    for before in needs(stage, config):
        if not sound(spark, base, before):
            return None
        parts.append(identity(stage_record(spark, f"{base}/{STAGES}", before)))
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _skip(spark: SparkSession, base: str, stage: str, config: CorpusConfig, force: bool, args: dict) -> bool:
    key = None if force else _fingerprint(spark, base, stage, config, args)
    return is_done(spark, f"{base}/{STAGES}", stage, key, _artifacts(spark, base, stage))


@contextmanager
def _run(spark: SparkSession, base: str, stage: str, config: CorpusConfig, args: dict) -> Iterator[tuple[str, dict]]:
    """A run of a stage: gives its folder and the row counts to fill in, and publishes it if nothing is raised.

    The fingerprint is that of the start, so inputs that change meanwhile make it run again.
    """
    built_on = require_sound(spark, base, *needs(stage, config))
    key, folder, rows = _fingerprint(spark, base, stage, config, args) or "", new_run(base, _holder(stage)), {}
    try:
        yield folder, rows
    except BaseException:
        delete(spark, folder)
        raise
    metadata = {"args": args, "rows": rows}
    publish(spark, base, stage, key, folder, built_on, metadata)
    if _holder(stage) != stage:
        publish(spark, base, _holder(stage), key, folder, {}, metadata)


def run_preprocess(
    spark: SparkSession,
    csv: str,
    base: str,
    config: CorpusConfig = CorpusConfig(),
    long_ids: bool = False,
    script: str = BENGALI,
    force: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV to featured, split pairs; returns the split table.

    Three tables are written: the raw rows, the clean, unique, featured ones, and those
    by split. Profiles and splits read them instead of repeating the work before them.
    The record tells the rows read, how many of them were malformed, and those left by
    cleaning and by deduplication.
    """
    args = {"paths": [csv], "long_ids": long_ids, "script": script, "multi_line": multi_line}
    if not _skip(spark, base, "preprocess", config, force, args):
        with _run(spark, base, "preprocess", config, args) as (folder, rows):
            # Counted by the tasks that write: only the attempt that counts as done is counted.
            seen = Observation("seen")
            raw = dev_subset(read_pairs(spark, csv, long_ids, multi_line, corrupt=True), config.dev_subset)
            kept = of_normalized(lambda s, t: is_clean(s, t, config.min_tokens, config.max_tokens))
            counts = [
                F.count(F.lit(1)).alias("rows_in"),
                F.count_if(F.col(CORRUPT).isNotNull()).alias("rows_corrupt"),
                F.count_if("_kept").alias("rows_clean"),
            ]
            raw = raw.withColumn("_kept", kept).observe(seen, *counts).drop(CORRUPT, "_kept")
            raw = write_parquet(raw, f"{folder}/raw/raw.parquet")
            record = validation_record(raw, "raw", script)
            json_summary_sink(record, f"{folder}/reports/raw_validation_summary.json")
            require_valid(spark.read.json(f"{folder}/reports/raw_validation_summary.json"))

            pairs = clean_pairs(raw, config.min_tokens, config.max_tokens)
            pairs = deduplicate(pairs, config.near_dup_method, config.near_dup_min_similarity)
            featured = write_parquet(add_features(pairs, script=script), f"{folder}/interim/featured.parquet")
            record = validation_record(featured, "clean", script)
            json_summary_sink(record, f"{folder}/reports/validation_summary.json")
            summary = require_valid(spark.read.json(f"{folder}/reports/validation_summary.json"))

            split = split_rows(featured, config.train_split, config.validation_split, config.seed)
            write_parquet(split, f"{folder}/processed", ("split",))
            rows |= seen.get | {"rows_out": summary.first()["total_rows"]}
    return spark.read.parquet(output(spark, base, "preprocess", "processed"))


def run_eda(
    spark: SparkSession, base: str, config: CorpusConfig = CorpusConfig(), force: bool = False
) -> DataFrame:
    """Statistics and histograms of all featured pairs; returns the statistics."""
    if not _skip(spark, base, "eda_report", config, force, {}):
        with _run(spark, base, "eda_report", config, {}) as (folder, _):
            featured = spark.read.parquet(output(spark, base, "preprocess", "interim/featured.parquet"))
            json_summary_sink(eda_record(featured), f"{folder}/reports/eda_stats.json")
            histogram(featured).coalesce(1).write.mode("overwrite").json(f"{folder}/reports/histogram.json")
    return spark.read.json(output(spark, base, "eda_report", "reports/eda_stats.json"))


def run_augment(
    spark: SparkSession,
    base: str,
    synonyms: DataFrame | None = None,
    config: CorpusConfig = CorpusConfig(),
    script: str = BENGALI,
    force: bool = False,
    inputs_id: str | None = None,
) -> DataFrame:
    """The train split and its augmented copies; ``inputs_id`` names the synonym table."""
    args = {"script": script, "inputs_id": "no synonyms" if synonyms is None else inputs_id}
    if not _skip(spark, base, "augmentation", config, force, args):
        with _run(spark, base, "augmentation", config, args) as (folder, _):
            rows = augment_train(
                split_source(spark, base, "train"),
                synonyms,
                script=script,
                synonym_prob=config.synonym_prob,
                swap_prob=config.swap_prob,
                deletion_prob=config.deletion_prob,
                min_tokens=config.min_tokens_after_aug,
                seed=config.seed,
            )
            write_parquet(rows, f"{folder}/augmented/train.parquet")
    return spark.read.parquet(output(spark, base, "augmentation", "augmented/train.parquet"))


def run_encode(
    spark: SparkSession,
    base: str,
    config: CorpusConfig = CorpusConfig(),
    force: bool = False,
) -> DataFrame:
    """Model inputs of every model and split, from a vocabulary of the train split.

    Augmented training data must have been made from the splits in force.
    """
    if not _skip(spark, base, "encode", config, force, {}):
        with _run(spark, base, "encode", config, {}) as (folder, _):
            train = split_source(spark, base, "train", config.use_augmented_train)
            vocab = write_parquet(build_vocab(train, config.vocab_size), f"{folder}/interim/vocab.parquet")
            parts = [train] + [split_source(spark, base, s) for s in SPLITS[1:]]
            rows = reduce(
                DataFrame.unionByName,
                [p.select(SL, ID, SOURCE, TARGET, F.lit(s).alias("split")) for s, p in zip(SPLITS, parts)],
            )
            encoded = encode_all(
                rows,
                vocab,
                config.models,
                max_input_length=config.max_input_length,
                max_target_length=config.max_target_length,
            )
            write_parquet(encoded, f"{folder}/encoded", ("model_key", "split"))
    return spark.read.parquet(output(spark, base, "encode", "encoded"))


def run_evaluate(
    spark: SparkSession,
    triples: DataFrame,
    base: str,
    config: CorpusConfig = CorpusConfig(),
    model_key: str | None = None,
    force: bool = False,
    inputs_id: str | None = None,
    **inputs,
) -> DataFrame:
    """Score one model or all; scores are kept as JSON and summed up in one CSV.

    A run takes over the scores of the models that it doesn't score, so the summary has
    all models scored so far. ``inputs_id`` names the predictions and whatever else is
    scored with them.
    """
    stage = "evaluate" if model_key is None else f"evaluate_{model_key}"
    args = {"inputs_id": inputs_id, "model_key": model_key, "tokenizer": inputs.get("tokenizer")}
    if not _skip(spark, base, stage, config, force, args):
        with _run(spark, base, stage, config, args) as (folder, _):
            known = output(spark, base, stage, "metrics/runs")
            scores = evaluate_all(triples, **inputs) if model_key is None else evaluate_run(triples, model_key, **inputs)
            runs = write_run_metrics(scores, f"{folder}/metrics/new")
            rows = spark.read.option("recursiveFileLookup", True).json(runs)
            if exists(spark, known):
                before = spark.read.option("recursiveFileLookup", True).json(known)
                rows = rows.unionByName(before.join(rows.select("model_key"), "model_key", "left_anti"), allowMissingColumns=True)
            write_run_metrics(rows, f"{folder}/metrics/runs")
            delete(spark, runs)
            write_run_summary(read_run_metrics(spark, f"{folder}/metrics/runs"), f"{folder}/metrics/summary.csv")
    scores = read_run_metrics(spark, output(spark, base, stage, "metrics/runs"))
    return scores if model_key is None else scores.filter(F.col("model_key") == model_key)


def pipeline_status(spark: SparkSession, base: str, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """A row for each stage's artifact: whether it is there, and the stage's state and rows.

    A stage is DONE only if it would be skipped (same settings, same inputs, outputs
    whole, built on the records in force) and every stage before it is. Row counts are
    those of its record.
    """

    def done(stage: str) -> bool:
        record = stage_record(spark, f"{base}/{STAGES}", stage)
        if record is None:
            return False
        args = json.loads(record["metadata"]).get("args", {})
        return _skip(spark, base, stage, config, False, args) and all(map(done, needs(stage, config)))

    rows = []
    for stage, artifacts in OUTPUTS.items():
        record = stage_record(spark, f"{base}/{STAGES}", stage)
        counts = json.loads(record["metadata"]).get("rows", {}) if record else {}
        status = "DONE" if done(stage) else "pending"
        for artifact in artifacts:
            state = "OK" if output_ready(spark, output(spark, base, stage, artifact)) else "missing"
            rows.append((stage, status, artifact, state, *(counts.get(c) for c in ("rows_in", "rows_clean", "rows_out"))))
    schema = "stage string, status string, artifact string, state string, rows_in long, rows_clean long, rows_out long"
    return spark.createDataFrame(rows, schema)
