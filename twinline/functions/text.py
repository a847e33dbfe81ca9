"""Column expressions over text: normalising, counting, tokenising."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that decide results.
CONTROL_CHARS = r"\p{Cc}"  # U+0000 to U+001F and U+007F to U+009F
ASCII_SPACE = r"\s+"
BLANK = " "
UNICODE_SPACE = r"(?U)[\s\x1C-\x1F]+"
BENGALI = r"[\u0980-\u09FF]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes.

    Without this, a value that a lambda mentions is computed for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(c: Column) -> Column:
    """Delete control characters, collapse blanks, trim.

    All ASCII whitespace but U+0020 is a control character, so after the
    deletion only runs of U+0020 are left to collapse.
    """
    visible = F.regexp_replace(c, CONTROL_CHARS, "")
    return F.trim(F.regexp_replace(visible, " {2,}", " "))


def token_count(c: Column, separator: str = ASCII_SPACE) -> Column:
    """Number of whitespace-separated tokens; 1 for empty text, null for null.

    Normalised text holds single blanks only; splitting it at ``BLANK`` gives the
    same count without a regular expression.
    """
    return F.size(F.split(F.trim(c), separator))


def token_set(c: Column) -> Column:
    """Distinct lower-cased tokens, split without trimming."""
    return F.array_distinct(F.split(F.lower(c), ASCII_SPACE))


def words(c: Column) -> Column:
    """Tokens split at any Unicode whitespace, without empty ones."""
    return F.array_remove(F.split(c, UNICODE_SPACE), "")


def has_script(c: Column, script: str = BENGALI) -> Column:
    return F.rlike(c, F.lit(script))


def share_outside_script(c: Column, script: str = BENGALI) -> Column:
    """Share of characters not in ``script``; 0 for empty text."""
    return F.length(F.regexp_replace(c, script, "")) / F.greatest(F.length(c), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by a blank, which no token contains."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
            lambda i: F.array_join(F.slice(tokens, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def uniform(seed: int, key: Column, op: str, position: Column | int = 0) -> Column:
    """A repeatable draw from [0, 1) fixed by seed, row key, purpose and position."""
    position = F.lit(position) if isinstance(position, int) else position
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(op), position.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
