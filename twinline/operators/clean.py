"""Normalising and filtering sentence pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.columns import SOURCE, TARGET
from twinline.functions.text import ASCII_SPACE, BLANK, has_script, let, normalize, token_count


def normalize_text(df: DataFrame, columns=(SOURCE, TARGET)) -> DataFrame:
    """Replace each column by its normalised text.

    The texts pass through a one-element array so that later filters stay above
    it. A plain projection would be merged into every filter, and the regular
    expressions would run again for each condition.
    """
    others = [c for c in df.columns if c not in columns]
    texts = F.struct(*[normalize(F.col(c)).alias(c) for c in columns])
    return df.select(*others, F.inline(F.array(texts))).select(*df.columns)


def drop_null_or_empty(df: DataFrame, source: str = SOURCE, target: str = TARGET) -> DataFrame:
    # A null length is not above zero, so this drops nulls as well.
    return df.filter((F.length(source) > 0) & (F.length(target) > 0))


def drop_trivial(df: DataFrame, source: str = SOURCE, target: str = TARGET) -> DataFrame:
    return df.filter(F.col(source) != F.col(target))


def _count_within(c: Column, low: int, high: int, separator: str) -> Column:
    # low <= n <= high with n mentioned, and so computed, only once.
    return F.abs(token_count(c, separator) * 2 - (low + high)) <= high - low


def length_band(
    df: DataFrame,
    low: int = 3,
    high: int = 256,
    source: str = SOURCE,
    target: str = TARGET,
    separator: str = ASCII_SPACE,
) -> DataFrame:
    """Keep pairs whose token counts both lie in [low, high]."""
    return df.filter(
        _count_within(F.col(source), low, high, separator) & _count_within(F.col(target), low, high, separator)
    )


def is_clean(source: Column, target: Column, min_tokens: int = 3, max_tokens: int = 256) -> Column:
    """Whether :func:`clean_pairs` keeps a pair of normalised texts; never null."""
    filled = (F.length(source) > 0) & (F.length(target) > 0) & (source != target)
    bearable = _count_within(source, min_tokens, max_tokens, BLANK) & _count_within(target, min_tokens, max_tokens, BLANK)
    return F.coalesce(filled & bearable, F.lit(False))


def of_normalized(body: Callable[[Column, Column], Column], source: str = SOURCE, target: str = TARGET) -> Column:
    """An expression of both normalised texts, which are made once however often it mentions them."""
    texts = F.struct(normalize(F.col(source)).alias("source"), normalize(F.col(target)).alias("target"))
    return let(texts, lambda t: body(t["source"], t["target"]))


def clean_pairs(df: DataFrame, min_tokens: int = 3, max_tokens: int = 256) -> DataFrame:
    """Normalise, then keep non-empty, non-trivial pairs of bearable length."""
    kept = drop_trivial(drop_null_or_empty(normalize_text(df)))
    return length_band(kept, min_tokens, max_tokens, separator=BLANK)


def script_match(df: DataFrame, script: str, column: str = SOURCE) -> DataFrame:
    return df.filter(has_script(F.col(column), script))
