import pytest
from pyspark.sql import functions as F

from twinline.functions import text


def value(spark, given, expression):
    return spark.createDataFrame([(given,)], "c string").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a\nb", "ab"),
        ("  a   b ", "a b"),
        ("a  b", "a  b"),
        ("\t", ""),
        ("a \t b", "a b"),
        ("a\x00\x7f\x9fb", "ab"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, given, expected):
    assert value(spark, given, text.normalize) == expected


@pytest.mark.parametrize("given, expected", [("", 1), (None, None), (" a b ", 2), ("a\t\tb c", 3)])
def test_token_count(spark, given, expected):
    assert value(spark, given, text.token_count) == expected


@pytest.mark.parametrize("given", ["", "a", "a b", "  a b\x1cc  ", "x　y", "\x85"])
def test_words_agree_with_python(spark, given):
    assert value(spark, given, text.words) == given.split()


@pytest.mark.parametrize("given", ["a", "a b", "à b c", "x y  z w"])
def test_blank_separator_counts_like_whitespace_on_normal_text(spark, given):
    both = lambda c: F.struct(
        text.token_count(text.normalize(c)), text.token_count(text.normalize(c), text.BLANK)
    )
    assert len(set(value(spark, given, both))) == 1


def test_ngrams(spark):
    cut = lambda n: value(spark, "a b c", lambda c: text.ngrams(F.split(c, " "), n))
    assert cut(1) == ["a", "b", "c"]
    assert cut(2) == ["a b", "b c"]
    assert cut(3) == ["a b c"]
    assert cut(4) == []


def test_uniform_is_fixed_and_even(spark):
    draws = spark.range(4000).select(text.uniform(42, F.col("id"), "x").alias("u"))
    low, high, mean = draws.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.02
    assert draws.repartition(7).exceptAll(draws).count() == 0
