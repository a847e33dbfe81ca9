import pytest
from pyspark.sql import functions as F

from twinline.columns import SL, SOURCE
from twinline.functions.text import words
from twinline.operators import augment, split
from twinline.operators.features import add_features


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(3000).select(
        F.col("id").alias(SL),
        F.col("id"),
        F.concat_ws(" ", F.lit("the"), *[F.concat(F.lit(c), F.col("id")) for c in "abcde"]).alias(SOURCE),
        F.lit("some target text").alias("paraphrased_sentence"),
    )


def test_split_is_whole_disjoint_and_fixed(many):
    dealt = split.split_rows(many)
    counts = {r["split"]: r["count"] for r in split.split_counts(dealt).collect()}
    assert sum(counts.values()) == 3000
    assert abs(counts["train"] - 2400) < 100 and abs(counts["val"] - 300) < 60
    assert dealt.exceptAll(split.split_rows(many.repartition(7))).count() == 0
    assert split.split_rows(many, seed=1).exceptAll(dealt).count() > 0


def test_split_by_source_leaks_nothing(pairs):
    df = pairs(*[(i, f"source {i // 5}", f"target {i}") for i in range(200)])
    dealt = split.split_rows(df, key=F.col(SOURCE))
    assert dealt.groupBy(SOURCE).agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def edited(df, edit):
    return [
        (r["before"], r["after"])
        for r in df.select(
            words(F.col(SOURCE)).alias("before"), edit(words(F.col(SOURCE)), F.col(SL)).alias("after")
        ).collect()
    ]


def test_adjacent_swap(many):
    places = set()
    for before, after in edited(many, lambda t, k: augment.adjacent_swap(t, k, 1.0)):
        moved = [i for i, (a, b) in enumerate(zip(before, after)) if a != b]
        assert sorted(before) == sorted(after) and len(moved) == 2 and moved[1] == moved[0] + 1
        places.add(moved[0])
    assert places == {0, 1, 2, 3, 4}
    assert all(b == a for b, a in edited(many, lambda t, k: augment.adjacent_swap(t, k, 0.0)))


def test_random_delete(many):
    gone = set()
    for before, after in edited(many, lambda t, k: augment.random_delete(t, k, 1.0, 3)):
        assert len(after) == 5
        at = next((i for i in range(5) if before[i] != after[i]), 5)
        assert before[:at] + before[at + 1 :] == after
        gone.add(at)
    assert gone == {0, 1, 2, 3, 4, 5}
    assert all(b == a for b, a in edited(many, lambda t, k: augment.random_delete(t, k, 1.0, 6)))
    changed = sum(b != a for b, a in edited(many, lambda t, k: augment.random_delete(t, k, 0.25, 3)))
    assert abs(changed - 750) < 120


def test_synonyms_of_a_large_table(spark, many):
    rows = [("the", ["a", "this"]), (None, ["x"]), ("b1", []), ("b2", None)] + [(f"a{i}", [f"A{i}"]) for i in range(1000)]
    synonyms = spark.createDataFrame(rows, "token string, alternatives array<string>")
    tokens = many.select(SL, words(F.col(SOURCE)).alias("tokens"))
    replaced = [r["tokens"][0] for r in augment.synonym_replace(tokens, synonyms, 0.4).collect()]
    assert set(replaced) == {"the", "a", "this"}
    assert abs(sum(t != "the" for t in replaced) - 1200) < 150


def test_synonyms_tell_null_keys_and_tokens_apart(spark):
    rows = [(5, ["a", "b"]), (None, ["5", "a", "b"]), (6, ["a", None]), (7, None), (8, [])]
    df = spark.createDataFrame(rows, f"{SL} int, tokens array<string>")
    synonyms = spark.createDataFrame([("a", ["A"]), (None, ["N"])], "token string, alternatives array<string>")
    got = {r[SL]: r["tokens"] for r in augment.synonym_replace(df, synonyms, 1.0).collect()}
    assert got == {5: ["A", "b"], None: ["5", "A", "b"], 6: ["A", None], 7: None, 8: []}


def test_augment_text_edges(pairs):
    df = pairs((1, "a  b", "x"), (2, None, "x"), (3, "", "x"), (4, " a  b  c ", "x"), (5, "one two three four", "x"))
    result = {r[SL]: r[SOURCE] for r in augment.augment_text(df, None, swap_prob=1.0, deletion_prob=1.0).collect()}
    assert result[1] == "a  b" and result[2] is None and result[3] == ""
    assert sorted(result[4].split()) == ["a", "b", "c"]  # as many as the minimum: nothing deleted
    assert len(result[5].split()) == 3
    plain = augment.augment_text(df, None, swap_prob=0.0, deletion_prob=0.0).filter(f"{SL} = 4").first()
    assert plain[SOURCE] == "a b c"


def test_augment_train_doubles_rows_and_renews_features(spark, many):
    synonyms = spark.createDataFrame([("the", ["of the"])], "token string, alternatives array<string>")
    both = augment.augment_train(add_features(many), synonyms, synonym_prob=1.0, swap_prob=0, deletion_prob=1.0)
    counts = {r["is_augmented"]: r["count"] for r in both.groupBy("is_augmented").count().collect()}
    assert counts == {False: 3000, True: 3000}
    copies = both.filter("is_augmented")
    assert copies.drop("is_augmented").exceptAll(add_features(copies.select(*many.columns))).count() == 0
    originals = both.filter("not is_augmented").drop("is_augmented")
    assert originals.exceptAll(add_features(many)).count() == 0
    assert "is_augmented" in augment.augment_train(many, None).columns
