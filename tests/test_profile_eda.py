import pytest
from pyspark.sql import functions as F

from twinline.columns import SOURCE, TARGET
from twinline.functions.text import BENGALI
from twinline.operators import eda, profile
from twinline.operators.clean import clean_pairs
from twinline.operators.dedup import exact_dedup
from twinline.operators.features import add_features


def test_profile(pairs):
    df = pairs((1, "ডেঙ্গু", "x"), (1, "abc", None), (None, None, "y"), (None, "রোগ", "z"), (2, "q", "w"))
    row = profile.profile(df).first()
    assert row["total_rows"] == 5
    assert row[f"{SOURCE}_nulls"] == 1 and row[f"{TARGET}_nulls"] == 1 and row["id_nulls"] == 2
    assert row["duplicate_ids"] == 2  # id 1 and the null id
    assert row["script_coverage"] == pytest.approx(2 / 5)
    assert profile.script_coverage(df, BENGALI).first()[0] == pytest.approx(2 / 5)
    assert {(r["id"], r["count"]) for r in profile.duplicate_ids(df).collect()} == {(1, 2), (None, 2)}


def test_empty_table(pairs):
    empty = pairs((1, "a", "b")).limit(0)
    row = profile.profile(empty).first()
    assert row["total_rows"] == 0 and row["script_coverage"] == 0.0 and row["duplicate_ids"] == 0
    assert profile.script_coverage(empty).first()[0] == 0.0
    assert eda.eda_summary(add_features(empty)).first()["src_len_mean"] == 0.0
    with pytest.raises(ValueError):
        profile.validate_raw(empty)
    with pytest.raises(ValueError):
        profile.validate_clean(empty)


def test_gates(pairs):
    with_null = pairs((1, "a", None), (1, "b", "c"))
    assert profile.validate_raw(with_null).first()["valid"]
    with pytest.raises(ValueError):
        profile.validate_clean(with_null)
    # Null and repeated ids do not fail the gate.
    record = profile.validate_clean(pairs((1, "a", "b"), (1, "c", "d"), (None, "e", "f"))).first()
    assert record["valid"] and record["stage"] == "clean" and record["duplicate_ids"] == 1


def test_before_after_counts(pairs):
    df = pairs((1, "a b c", "d e f"), (2, "a b c", "d e f"), (3, "x", "y"), (4, None, "d e f"))
    assert tuple(profile.before_after_counts(df).first()) == (4, 2, 1)


def test_tokens(pairs):
    df = pairs((1, "b a b", "z z"), (2, "a c", "q"), (3, None, "z"))
    frequency = eda.token_frequency(df)
    assert {tuple(r) for r in frequency.collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert [r["token"] for r in eda.top_tokens(frequency, 2).collect()] == ["a", "b"]
    assert eda.vocab_size(frequency).first()[0] == 3
    both = {tuple(r) for r in eda.token_frequency(df, (SOURCE, TARGET)).collect()}
    assert ("z", 3) in both and ("a", 2) in both


def test_numeric_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("sl"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    assert eda.numeric_sample(df, "v").count() == 2500
    part = eda.numeric_sample(df, "v", 0.2)
    assert 400 < part.count() < 600
    assert part.exceptAll(eda.numeric_sample(df.repartition(9), "v", 0.2)).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 3.0), (1.0, 3.0), (5.0, 3.0), (10.0, 3.0), (None, None)], "x double, y double")
    rows = {(r["column"], r["bin"]): r for r in eda.histogram(df, ("x", "y"), bins=10).collect()}
    assert len(rows) == 20
    counts = [rows["x", b]["count"] for b in range(10)]
    assert counts == [1, 1, 0, 0, 0, 1, 0, 0, 0, 1]  # the maximum is in the last bin
    assert sum(rows["y", b]["count"] > 0 for b in range(10)) == 1
    assert rows["y", 0]["bin_low"] == 2.5 and rows["y", 9]["bin_high"] == 3.5


def test_histogram_agrees_with_numpy(spark):
    import numpy as np

    values = np.random.default_rng(1).integers(0, 37, 3000) / 7
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts = [r["count"] for r in eda.histogram(df, ("x",)).orderBy("bin").collect()]
    assert counts == np.histogram(values, 50)[0].tolist()


def test_eda_record(pairs):
    record = eda.eda_record(add_features(pairs((1, "b a b", "x y z"), (2, "a c", "q"))), 2).first()
    assert record["total_rows"] == 2 and record["vocab_size"] == 3
    assert [tuple(t) for t in record["top_tokens"]] == [("a", 2), ("b", 2)]
    assert record["src_len_mean"] == 2.5


def test_before_after_counts(pairs):
    df = pairs(
        (1, "one two three", "four five six"), (2, " one  two three ", "four five\x00 six"), (3, "one two three", "one two three"),
        (4, None, "four five six"), (5, "one two", "four five six"), (6, "", ""), (7, "seven eight nine", "four five six"),
    )
    row = profile.before_after_counts(df).first()
    cleaned = clean_pairs(df)
    assert tuple(row) == (7, cleaned.count(), exact_dedup(cleaned).count()) == (7, 3, 2)
    assert tuple(profile.before_after_counts(df.limit(0)).first()) == (0, 0, 0)
    plan = profile.before_after_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Subquery" not in plan  # one pass


def test_vocabulary_sketches(spark, pairs):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 30_000}" for j in range(40)), "x") for i in range(5000)]
    df = pairs(*rows).withColumn("part", F.col("id") % 5)
    exact = eda.vocab_size(eda.token_frequency(df)).first()[0]
    kept = [eda.token_sketches(df.filter(F.col("part") == p)) for p in range(5)]
    merged = eda.estimated_vocab_size(kept[0].union(kept[1]).union(kept[2]).union(kept[3]).union(kept[4])).first()[0]
    assert abs(merged - exact) <= 0.02 * exact
    by_part = {r["part"]: r["vocab_size"] for r in eda.estimated_vocab_size(eda.token_sketches(df, ("part",)), ("part",)).collect()}
    for p in range(5):
        own = eda.vocab_size(eda.token_frequency(df.filter(F.col("part") == p))).first()[0]
        assert abs(by_part[p] - own) <= 0.02 * own
    assert eda.estimated_vocab_size(eda.token_sketches(df.limit(0))).first()[0] == 0
