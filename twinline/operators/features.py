"""Length, overlap, edit-distance and script features of a pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from twinline.columns import SOURCE, TARGET
from twinline.functions.editing import distances
from twinline.functions.text import BENGALI, let, share_outside_script, token_count, token_set
from twinline.session import ship


def src_len(source: str = SOURCE) -> Column:
    return token_count(F.col(source))


def tgt_len(target: str = TARGET) -> Column:
    return token_count(F.col(target))


def src_char_len(source: str = SOURCE) -> Column:
    return F.length(source)


def tgt_char_len(target: str = TARGET) -> Column:
    return F.length(target)


def len_ratio(source: str = SOURCE, target: str = TARGET) -> Column:
    """Source tokens per target token; 0 if the target is null."""
    return F.when(tgt_len(target) > 0, src_len(source) / tgt_len(target)).otherwise(F.lit(0.0))


def word_overlap(source: str = SOURCE, target: str = TARGET) -> Column:
    """Jaccard similarity of the lower-cased token sets; 0 if a side is null."""
    def overlap(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets["left"], sets["right"]))
        return let(shared, lambda n: n / (F.size(sets["left"]) + F.size(sets["right"]) - n))

    # Each set is made once; none is empty.
    sets = F.struct(token_set(F.col(source)).alias("left"), token_set(F.col(target)).alias("right"))
    known = F.col(source).isNotNull() & F.col(target).isNotNull()
    return F.when(known, let(sets, overlap)).otherwise(F.lit(0.0))


@F.pandas_udf(IntegerType())
def edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Characters to insert, delete or replace; null if a side is null.

    Bit-parallel, 64 characters a step, many pairs at once.
    """
    found = pd.Series(pd.NA, left.index, dtype="Int32")
    known = left.notna() & right.notna()
    found[known] = distances(left[known].tolist(), right[known].tolist())
    return found


def char_overlap(source: str = SOURCE, target: str = TARGET) -> Column:
    """Edit distance over the longer length: 0 means equal, despite the name."""
    ship(SparkSession.active())
    longest = F.greatest(F.length(source), F.length(target), F.lit(1))
    return edit_distance(F.col(source), F.col(target)) / longest


def bn_char_ratio(source: str = SOURCE, script: str = BENGALI) -> Column:
    """Share of source characters *outside* the script, despite the name."""
    return share_outside_script(F.col(source), script)


# What the two misnamed columns really hold.
edit_distance_ratio = char_overlap
non_script_ratio = bn_char_ratio


def feature_columns(source: str = SOURCE, target: str = TARGET, script: str = BENGALI) -> dict[str, Column]:
    return {
        "src_len": src_len(source),
        "tgt_len": tgt_len(target),
        "src_char_len": src_char_len(source),
        "tgt_char_len": tgt_char_len(target),
        "len_ratio": len_ratio(source, target),
        "word_overlap": word_overlap(source, target),
        "char_overlap": char_overlap(source, target),
        "bn_char_ratio": bn_char_ratio(source, script),
    }


def add_features(
    df: DataFrame, source: str = SOURCE, target: str = TARGET, script: str = BENGALI
) -> DataFrame:
    """All eight features in one projection."""
    return df.withColumns(feature_columns(source, target, script))


PREFIX_TOKEN = "paraphrase:"
# The code of the corpus's language among those of mBART models.
LANGUAGE = "bn_IN"


def _is_mbart(model_name: str) -> bool:
    return "mbart" in model_name.lower()


def model_prefix(model_name: str) -> str:
    """Task prefix of a model; mBART models take language codes instead."""
    return "" if _is_mbart(model_name) else f"{PREFIX_TOKEN} "


def language_code(model_name: str, language: str = LANGUAGE) -> str | None:
    """The code of source and target that a model is given, if it takes one."""
    return language if _is_mbart(model_name) else None


def input_prefix(model_name: str, source: str = SOURCE) -> Column:
    return F.concat(F.lit(model_prefix(model_name)), F.col(source))


def language_columns(model_name: str, language: str = LANGUAGE) -> dict[str, Column]:
    """``src_lang`` and ``tgt_lang``, the codes that go with an mBART model's texts; null for others."""
    code = F.lit(language_code(model_name, language)).cast("string")
    return {"src_lang": code, "tgt_lang": code}
