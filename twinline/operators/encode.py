"""Vocabulary and fixed-length model inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from twinline.columns import ID, SL, SOURCE, TARGET
from twinline.config import ModelSpec
from twinline.functions.text import words
from twinline.operators.features import LANGUAGE, PREFIX_TOKEN, language_columns, model_prefix
from twinline.operators.selection import top_counts
from twinline.session import written

# Fixed ids; the words of the vocabulary follow.
PAD, UNKNOWN, PREFIX, FIRST_WORD = 0, 1, 2, 3

# Entries of a vocabulary that every worker is given as a dictionary (some 8 MB). A larger
# vocabulary is joined.
DICTIONARY_ROWS = 65_536


def build_vocab(df: DataFrame, size: int = 32_000, columns=(SOURCE, TARGET)) -> DataFrame:
    """The ``size`` most frequent tokens with consecutive ids, as ``(token, token_id, count)``.

    Tokens are what the encoder cuts (:func:`words`). The prefix token has an id of its
    own and is no word. Counts are written once; :func:`top_counts` selects from them, and
    the ids of what is left are numbered in one task, which reads ``size`` rows.
    """
    tokens = F.explode(F.concat(*[F.coalesce(words(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    counted = df.select(tokens.alias("token")).filter(F.col("token") != PREFIX_TOKEN).groupBy("token")
    top = top_counts(written(counted.agg(F.count("*").alias("count")), "counts"), size)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "token"))
    return top.select("token", (rank + (FIRST_WORD - 1)).alias("token_id"), "count")


def _by_dictionary(df: DataFrame, entries: dict[str, int], texts: dict[str, tuple[Column, int]]) -> DataFrame:
    table = df.sparkSession.sparkContext.broadcast(entries)

    def ids(text: Column, length: int) -> Column:
        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(texts: pd.Series) -> pd.Series:
            known = table.value
            # Like words(): split at any Unicode whitespace, no empty tokens.
            return texts.map(
                lambda t: None if t is None else [known.get(w, UNKNOWN) for w in t.split(None, length)[:length]]
            )

        return encode(text)

    return df.select("*", *(ids(text, length).alias(name) for name, (text, length) in texts.items()))


def _by_join(df: DataFrame, vocab: DataFrame, texts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Tokens become rows, meet the vocabulary, and are put in order again.

    Rows are numbered when they are written, so a number means the same row whenever it is
    read. The vocabulary has each token once: a frequent one is skewed on the rows' side
    only, which Spark splits.
    """
    cut = {f"_{name}": F.slice(words(text), 1, length) for name, (text, length) in texts.items()}
    rows = written(df.select("*", *(c.alias(name) for name, c in cut.items())).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    kinds = F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"_{name}").alias("tokens")) for name in texts))
    tokens = rows.select("_row", F.inline(kinds)).select("_row", "name", F.posexplode("tokens").alias("pos", "token"))
    own = F.when(F.col("token") == PREFIX_TOKEN, PREFIX).otherwise(F.coalesce("token_id", F.lit(UNKNOWN))).cast("int")
    known = tokens.join(vocab.select("token", "token_id"), "token", "left").select("_row", "name", "pos", own.alias("own"))
    lists = known.groupBy("_row").agg(
        *(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("name") == name, F.struct("pos", "own")))), lambda e: e["own"]
            ).alias(name)
            for name in texts
        )
    )
    nothing = F.array().cast("array<int>")
    ids = [F.when(F.col(f"_{name}").isNotNull(), F.coalesce(name, nothing)).alias(name) for name in texts]
    return rows.join(lists, "_row", "left").select(*df.columns, *ids)


def token_ids(
    df: DataFrame, vocab: DataFrame, texts: dict[str, tuple[Column, int]], dictionary_rows: int = DICTIONARY_ROWS
) -> DataFrame:
    """``df`` with an array of ids for each of ``texts``: name to (text, how many tokens at most).

    A vocabulary of up to ``dictionary_rows`` entries goes to every worker as a dictionary,
    and ids are looked up without a shuffle. No more than that many entries are ever
    fetched. A larger vocabulary is joined (:func:`_by_join`), whatever its size.
    """
    few = vocab.select("token", "token_id").limit(dictionary_rows + 1).toArrow()
    if few.num_rows > dictionary_rows:
        return _by_join(df, vocab, texts)
    entries = dict(zip(few.column("token").to_pylist(), few.column("token_id").to_pylist()))
    return _by_dictionary(df, entries | {PREFIX_TOKEN: PREFIX}, texts)


def _padded(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(ids)))


def _mask(ids: Column, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(length) - F.size(ids)))


def _inputs(keys, max_input_length: int, max_target_length: int) -> list:
    return [
        *keys,
        _padded(F.col("_input"), max_input_length).alias("input_ids"),
        _mask(F.col("_input"), max_input_length).alias("attention_mask"),
        _padded(F.col("_target"), max_target_length).alias("labels"),
    ]


def encode_pairs(
    df: DataFrame,
    vocab: DataFrame,
    prefix: str | Column,
    max_input_length: int = 128,
    max_target_length: int = 128,
    keys=(SL, ID),
    dictionary_rows: int = DICTIONARY_ROWS,
) -> DataFrame:
    """Prefix, look up, truncate and pad both texts.

    Gives ``input_ids``, ``attention_mask`` and ``labels`` of fixed lengths; the
    labels are the target's ids.
    """
    source = F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.col(SOURCE))
    rows = df.select(*keys, source.alias("_source_text"), F.col(TARGET).alias("_target_text"))
    texts = {"_input": (F.col("_source_text"), max_input_length), "_target": (F.col("_target_text"), max_target_length)}
    return token_ids(rows, vocab, texts, dictionary_rows).select(*_inputs(keys, max_input_length, max_target_length))


def encode_all(
    df: DataFrame,
    vocab: DataFrame,
    models: tuple[ModelSpec, ...],
    model_key: str | None = None,
    max_input_length: int = 128,
    max_target_length: int = 128,
    language: str = LANGUAGE,
    dictionary_rows: int = DICTIONARY_ROWS,
) -> DataFrame:
    """Every model's inputs for every split, told apart by ``model_key`` and ``split``.

    Texts are looked up once, whatever the number of models; a model puts the ids of its
    prefix before them. ``src_lang`` and ``tgt_lang`` are the codes that an mBART model
    is given in place of a prefix, and null for others.
    """
    specs = [m for m in models if model_key in (None, m.key)]
    if not specs:
        raise ValueError(f"no model is called {model_key!r}")
    rows = df.select("split", SL, ID, F.col(SOURCE).alias("_source_text"), F.col(TARGET).alias("_target_text"))
    texts = {"_source": (F.col("_source_text"), max_input_length), "_target": (F.col("_target_text"), max_target_length)}

    def of_model(m: ModelSpec) -> Column:
        # Prefixes are made of the prefix token alone.
        first = [PREFIX] * len(model_prefix(m.name).split())
        codes = [column.alias(name) for name, column in language_columns(m.name, language).items()]
        ids = F.slice(F.concat(F.array(*map(F.lit, first)).cast("array<int>"), F.col("_source")), 1, max_input_length)
        return F.struct(F.lit(m.key).alias("model_key"), *codes, ids.alias("_input"))

    per_model = token_ids(rows, vocab, texts, dictionary_rows).select(
        "split", SL, ID, "_target", F.inline(F.array(*map(of_model, specs)))
    )
    keys = ("model_key", "split", SL, ID, "src_lang", "tgt_lang")
    return per_model.select(*_inputs(keys, max_input_length, max_target_length))
