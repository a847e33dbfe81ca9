"""Scores of predictions against references.

Every row is scored by itself, without a shuffle; a run's score is one partial
aggregate over the rows, taken per group when several runs share a table.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from twinline.functions.text import let, ngrams, words
from twinline.session import ship

ORDERS = (1, 2, 3, 4)

# The 13a rules in order, as (text, replacement), a class of characters that are
# tokens, and (pattern, replacement) for what is left between blanks.
UNESCAPE_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
# The published class also holds the blank; padding blanks changes no token.
PUNCTUATION_13A = re.compile(r"[{-~\[-`!-&(-+:-@/]")
SEPARATE_13A = (
    (re.compile(r"([^0-9])([.,])"), r"\1 \2 "),
    (re.compile(r"([.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def _unescaped_13a(text: str | None) -> str:
    text = text or ""
    if "&" in text or "<" in text or "\n" in text:
        for literal, replacement in UNESCAPE_13A:
            text = text.replace(literal, replacement)
    return text


def _pieces_13a(word: str) -> list[str]:
    """The tokens of what stands between blanks. The rules are tried where they can fit."""
    if word[-1] in ".," and word[:-1].isalnum():
        return [word[:-1], word[-1]]
    tokens = []
    for token in PUNCTUATION_13A.sub(r" \g<0> ", word).split():
        if "." in token or "," in token or "-" in token:
            token = f" {token} "
            for pattern, replacement in SEPARATE_13A:
                token = pattern.sub(replacement, token)
            tokens += token.split()
        else:
            tokens.append(token)
    return tokens


def _tokens_13a(text: str | None) -> list[str]:
    """The tokens that mteval-v13a cuts."""
    return [token for word in _unescaped_13a(text).split() for token in _pieces_13a(word)]


@F.pandas_udf(StringType())
def spaced_13a(text: pd.Series) -> pd.Series:
    """The text with blanks between the tokens that mteval-v13a cuts."""
    return text.map(lambda t: " ".join(_tokens_13a(t)), na_action="ignore")


BLEU_COLUMNS = ("sys_len", "ref_len") + tuple(f"{kind}_{n}" for n in ORDERS for kind in ("match", "total"))


def _numbered(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """A number for each text, the same for equal ones, and the text of each number."""
    encoded = pa.array(texts, pa.large_string()).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Lists:
    """Lists of numbers in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, lists: list[list[str]]) -> tuple[Lists, list[str]]:
        """Numbers in place of the texts in lists, and the texts that they stand for."""
        flat, texts = _numbered(list(chain.from_iterable(lists)))
        return cls(flat, np.fromiter(map(len, lists), np.int64, len(lists))), texts

    def at(self, places: np.ndarray) -> Lists:
        """The lists at these places."""
        return Lists(self.flat[_spans(self.starts[places], self.sizes[places])], self.sizes[places])

    def of_elements(self, lists: Lists) -> Lists:
        """Each element replaced by the list that it is the number of."""
        sizes = np.concatenate(([0], np.cumsum(lists.sizes[self.flat])))
        return Lists(lists.at(self.flat).flat, sizes[self.starts + self.sizes] - sizes[self.starts])


class Texts:
    """The texts of a batch, each different one cut once, and each different word of them."""

    def __init__(self, *columns: list[str | None]):
        places, texts = _numbered([t or "" for column in columns for t in column])
        unescaped, every = _numbered([*texts, *map(_unescaped_13a, texts)])  # the texts keep their numbers
        self.plain = np.split(places, np.cumsum([len(column) for column in columns])[:-1])
        self.unescaped = [unescaped[len(texts) :][places] for places in self.plain]
        self.words, words = Lists.of([t.split() for t in every])  # at the white space that words() splits at
        pieces, sizes = [], np.ones(len(words), np.int64)
        for i, word in enumerate(words):
            if word.isalnum():
                pieces.append(word)
            else:
                found = _pieces_13a(word)
                pieces += found
                sizes[i] = len(found)
        self.tokens = self.words.of_elements(Lists(_numbered(pieces)[0], sizes))

    def unique(self, column: int) -> dict[str, np.ndarray]:
        """For each text of a column, how many words and pairs of words it has, and how many different ones."""
        texts, places = np.unique(self.plain[column], return_inverse=True)
        lists = self.words.at(texts)
        text, width = np.repeat(np.arange(len(texts)), lists.sizes), int(lists.flat.max(initial=0)) + 1
        grams, statistics = text * width + lists.flat, {}
        for n in (1, 2):
            if n > 1:
                pairs = np.flatnonzero(text[1:] == text[:-1])
                grams, text = _ranks(grams)[0][pairs] * width + lists.flat[pairs + 1], text[pairs]
            first = _ranks(grams)[1]
            statistics[f"unique_{n}"] = np.bincount(text[first], minlength=len(texts))[places]
            statistics[f"grams_{n}"] = np.maximum(lists.sizes - n + 1, 0)[places]
        return statistics


def _order(values: np.ndarray) -> np.ndarray:
    """Places by rising value. Values and places are sorted as one number where both fit in."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()).bit_length() + bits < 64:
        return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)
    return np.argsort(values, kind="stable")


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the different ones, and a place of each of those."""
    order = _order(values)
    new = np.ones(len(order), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, order[new]


def clipped_matches(predictions: list[list[str]], references: list[list[str]]) -> np.ndarray:
    """For each row and order, how many n-grams match, each no more often than the reference has it."""
    both = Lists.of([*predictions, *references])[0]
    return _clipped_matches(*(both.at(places) for places in np.split(np.arange(len(both.sizes)), [len(predictions)])))


def _clipped_matches(predictions: Lists, references: Lists) -> np.ndarray:
    """All rows of a batch are counted in flat arrays. An n-gram is the number of its first
    n - 1 tokens' n-gram and that of its last token, numbered anew for each order, so that
    equal n-grams of a row, and no others, have one number.
    """
    tokens = np.concatenate((predictions.flat, references.flat))
    sizes = np.concatenate((predictions.sizes, references.sizes))
    rows, width = len(predictions.sizes), int(tokens.max(initial=0)) + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))  # tokens from here to the text's end
    found = np.zeros((rows, len(ORDERS)), np.int64)
    # A gram of a row: rows are told apart from the first order on, so none meets another's.
    grams, at = (text % max(1, rows)) * width + tokens, np.arange(len(tokens))
    for n in ORDERS:
        if n > 1:
            here = np.flatnonzero(left >= n)
            text, left, at = text[here], left[here], at[here]
            grams = grams[here] * width + tokens[at + n - 1]
        if not len(grams):
            break
        order = _order(grams)
        ranked = grams[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.flatnonzero(new)
        text = text[order]
        in_reference = np.add.reduceat((text >= rows).astype(np.int64), first)
        size = np.diff(first, append=len(ranked))
        matched = np.minimum(in_reference, size - in_reference)
        found[:, n - 1] = np.bincount(text[first] % rows, matched, rows).astype(np.int64)
        # Only what begins with a matched gram can match at the next order.
        common = np.repeat(matched > 0, size)
        grams, text, order = np.repeat(np.arange(len(first)), size)[common], text[common], order[common]
        left, at = left[order], at[order]
    return found


TEXT_COLUMNS = BLEU_COLUMNS + ("unique_1", "grams_1", "unique_2", "grams_2")


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in TEXT_COLUMNS] + [StructField("rouge_l", DoubleType())]))
def text_statistics(prediction: pd.Series, reference: pd.Series, rouge_p: pd.Series, rouge_r: pd.Series) -> pd.DataFrame:
    """All that the scores of texts are made of: texts as they are, and their tokens for ROUGE-L."""
    texts = Texts(prediction.tolist(), reference.tolist())
    statistics = _ngram_statistics(texts) | texts.unique(0) | {"rouge_l": _lcs_f1(rouge_p, rouge_r)}
    return pd.DataFrame(statistics, index=prediction.index)


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in BLEU_COLUMNS]))
def ngram_statistics(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Lengths, and per order the n-grams and those matched, each counted no more
    often than the reference has it."""
    return pd.DataFrame(_ngram_statistics(Texts(prediction.tolist(), reference.tolist())), index=prediction.index)


def _ngram_statistics(texts: Texts) -> dict[str, np.ndarray]:
    p, r = (texts.tokens.at(places) for places in texts.unescaped)
    matches = _clipped_matches(p, r)
    columns = {"sys_len": p.sizes, "ref_len": r.sizes}
    for n in ORDERS:
        columns |= {f"match_{n}": matches[:, n - 1], f"total_{n}": np.maximum(p.sizes - n + 1, 0)}
    return columns


def bleu_columns(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Add each row's lengths and n-gram matches and totals for orders 1 to 4."""
    ship(df.sparkSession)
    statistics = ngram_statistics(prediction, reference)
    return df.withColumn("_bleu", statistics).select(*df.columns, "_bleu.*")


def _bleu_sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BLEU_COLUMNS]


def _bleu_score() -> Column:
    """BLEU on a 0 to 100 scale from corpus sums.

    The k-th order without a match counts as 1 / (2^k total).
    """
    empty_orders = F.lit(0)
    log_sum = F.lit(0.0)
    for n in ORDERS:
        match, total = F.col(f"match_{n}"), F.col(f"total_{n}")
        empty_orders = empty_orders + F.when(match == 0, 1).otherwise(0)
        hits = F.when(match == 0, F.pow(F.lit(0.5), empty_orders)).otherwise(match)
        log_sum = log_sum + F.ln(hits / total)
    brevity = F.when(
        F.col("sys_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("sys_len"))
    ).otherwise(1.0)
    any_match = sum((F.col(f"match_{n}") for n in ORDERS), F.lit(0)) > 0
    # A total of 0 at the highest order includes every other total of 0.
    return F.when(any_match & (F.col("total_4") > 0), brevity * F.exp(log_sum / 4) * 100).otherwise(0.0)


def bleu(
    df: DataFrame, by: tuple[str, ...] = (), prediction: str = "prediction", reference: str = "reference"
) -> DataFrame:
    """Corpus BLEU with the sums behind it, per group of ``by``."""
    sums = bleu_columns(df, prediction, reference).groupBy(*by).agg(*_bleu_sums())
    return sums.withColumn("BLEU", _bleu_score())


def rouge_text(text: Column, tokenizer: str = "unicode") -> Column:
    """Lower-cased tokens with blanks between: runs of ASCII letters and digits,
    or of any script's letters, marks and digits."""
    dropped = {"ascii": r"[^a-z0-9]+", "unicode": r"[^\p{L}\p{M}\p{N}]+"}
    if tokenizer not in dropped:
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    return F.regexp_replace(F.lower(text), dropped[tokenizer], " ")


def _lcs_length(a, b) -> int:
    """Longest common subsequence; one bit per position of ``a``, one step per token of ``b``.

    Tokens at the begin and end that both have there belong to it; tokens that the other side lacks don't.
    """
    start, shorter = 0, min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < shorter - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return start + stop
    shared = set(a).intersection(b)
    a = [token for token in a if token in shared]
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for token in b:
        if token in shared:
            hit = row & where[token]
            row = ((row + hit) | (row - hit)) & full
    return start + stop + len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def lcs_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return _lcs_f1(prediction, reference)


def _lcs_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the common subsequence: 2PR / (P + R) with P = lcs / |p|, R = lcs / |r|."""
    scores = []
    tokens = {t: (t or "").split() for t in chain(prediction, reference)}
    for p, r in zip(map(tokens.get, prediction), map(tokens.get, reference)):
        scores.append(2 * _lcs_length(p, r) / (len(p) + len(r)) if p and r else 0.0)
    return pd.Series(scores, prediction.index, dtype="float64")


def rouge_l_columns(
    df: DataFrame, prediction: str = "prediction", reference: str = "reference", tokenizer: str = "unicode"
) -> DataFrame:
    """Add each row's ``rouge_l``: F1 of the longest common token subsequence."""
    ship(df.sparkSession)
    sides = (rouge_text(F.col(c), tokenizer) for c in (prediction, reference))
    return df.withColumn("rouge_l", lcs_f1(*sides))


def rouge_l(df: DataFrame, by: tuple[str, ...] = (), tokenizer: str = "unicode", **columns) -> DataFrame:
    return (
        rouge_l_columns(df, tokenizer=tokenizer, **columns)
        .groupBy(*by)
        .agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("ROUGE-L"))
    )


def distinct_columns(df: DataFrame, n: int, text: str = "prediction") -> DataFrame:
    """Add each row's number of distinct and of all n-grams."""
    tokens = words(F.col(text))
    df = df.withColumn("_grams", let(tokens, lambda ts: ngrams(ts, n)))
    return df.withColumns(
        {f"unique_{n}": F.size(F.array_distinct("_grams")), f"grams_{n}": F.size("_grams")}
    ).drop("_grams")


def _distinct_score(n: int) -> Column:
    total = F.coalesce(F.sum(f"grams_{n}"), F.lit(0))
    return F.coalesce(F.sum(f"unique_{n}"), F.lit(0)) / F.greatest(total, F.lit(1))


def distinct_n(df: DataFrame, n: int, by: tuple[str, ...] = (), text: str = "prediction") -> DataFrame:
    """Distinct n-grams within each text over all n-grams."""
    return distinct_columns(df, n, text).groupBy(*by).agg(_distinct_score(n).alias(f"Distinct-{n}"))


def text_scores(df: DataFrame, by: tuple[str, ...] = ("model_key",), tokenizer: str = "unicode") -> DataFrame:
    """BLEU, ROUGE-L, Distinct-1 and Distinct-2 of every group in one pass."""
    ship(df.sparkSession)
    sides = [F.col("prediction"), F.col("reference")]
    statistics = text_statistics(*sides, *(rouge_text(side, tokenizer) for side in sides))
    rows = df.withColumn("_text", statistics).select(*by, "_text.*")
    sums = rows.groupBy(*by).agg(
        *_bleu_sums(),
        F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("ROUGE-L"),
        _distinct_score(1).alias("Distinct-1"),
        _distinct_score(2).alias("Distinct-2"),
    )
    return sums.select(*by, _bleu_score().alias("BLEU"), "ROUGE-L", "Distinct-1", "Distinct-2")


# --- embeddings ----------------------------------------------------------------


def _dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: str, b: str) -> Column:
    """Cosine of two vector columns; 0 if one is all zero, null if one is null."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).when(norms == 0, 0.0)


def semantic_similarity(
    sources: DataFrame,
    predictions: DataFrame,
    key: tuple[str, ...] = ("pair_id",),
    by: tuple[str, ...] = (),
    name: str = "semantic_similarity",
) -> DataFrame:
    """Mean cosine of the source's and the prediction's embedding, row by row.

    Both tables are ``(*key, embedding)``; ``by`` are columns of the key. A key that one
    table lacks, or whose embedding is null, can't be scored: ``<name>_unmatched`` says how
    many there are, so a mean over part of the rows is not taken for one over all.
    """
    pairs = sources.select(*key, F.col("embedding").alias("_a")).join(
        predictions.select(*key, F.col("embedding").alias("_b")), list(key), "full"
    )
    unmatched = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return (
        pairs.withColumn("_cosine", cosine("_a", "_b"))
        .groupBy(*by)
        .agg(F.coalesce(F.avg("_cosine"), F.lit(0.0)).alias(name), unmatched.alias(f"{name}_unmatched"))
    )


def _unit_rows(matrix) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in matrix])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


@F.pandas_udf(
    StructType([StructField("precision", DoubleType()), StructField("recall", DoubleType())])
)
def best_matches(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Mean best cosine of each prediction token, and of each reference token."""
    scores = []
    for p, r in zip(prediction, reference):
        if p is None or r is None or len(p) == 0 or len(r) == 0:
            scores.append((0.0, 0.0))
            continue
        cosines = _unit_rows(p) @ _unit_rows(r).T
        scores.append((cosines.max(axis=1).mean(), cosines.max(axis=0).mean()))
    return pd.DataFrame(scores, columns=["precision", "recall"])


def greedy_match_f1(
    df: DataFrame,
    by: tuple[str, ...] = (),
    prediction: str = "prediction_tokens",
    reference: str = "reference_tokens",
    name: str = "BERTScore",
) -> DataFrame:
    """Mean F1 of greedy token matching; each row holds both sides' token vectors
    as ``ARRAY<ARRAY<FLOAT>>``, so pairs of tokens are never rows."""
    ship(df.sparkSession)
    p, r = F.col("_m.precision"), F.col("_m.recall")
    f1 = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0)
    return (
        df.withColumn("_m", best_matches(prediction, reference))
        .withColumn("_f1", f1)
        .groupBy(*by)
        .agg(F.coalesce(F.avg("_f1"), F.lit(0.0)).alias(name))
    )


# --- runs ----------------------------------------------------------------------

METRICS = ("BLEU", "ROUGE-L", "BERTScore", "Distinct-1", "Distinct-2", "semsim_mpnet", "semsim_bnsbert")


def evaluate_all(
    triples: DataFrame,
    models: DataFrame | None = None,
    token_matrices: DataFrame | None = None,
    embeddings: dict[str, tuple[DataFrame, DataFrame]] | None = None,
    tokenizer: str = "unicode",
) -> DataFrame:
    """One row of metrics per ``model_key``.

    ``triples`` is ``(model_key, id, source, prediction, reference)``. The other
    inputs are optional: names per model, token vectors for BERTScore, and under the
    name of the column that their similarity gets, the source and prediction
    embeddings of an encoder, keyed by model and pair; how many of these could not be scored
    is told beside it. What is joined here has one row per model.
    """
    scores = text_scores(triples, ("model_key",), tokenizer)
    if models is not None:
        scores = scores.join(models.select("model_key", "model_name"), "model_key", "left")
    if token_matrices is not None:
        scores = scores.join(greedy_match_f1(token_matrices, ("model_key",)), "model_key", "left")
    for name, (sources, predictions) in (embeddings or {}).items():
        similarity = semantic_similarity(sources, predictions, ("model_key", "pair_id"), ("model_key",), name)
        scores = scores.join(similarity, "model_key", "left")
    order = ("model_key", "model_name", *METRICS)
    others = sorted((c for c in scores.columns if c not in order), key=lambda c: not c.endswith("_unmatched"))
    return scores.select(*[f"`{c}`" for c in (*order, *others) if c in scores.columns])


def evaluate_run(triples: DataFrame, model_key: str, **inputs) -> DataFrame:
    """The metrics of one model; only its rows are read."""
    of_model = F.col("model_key") == model_key
    matrices = inputs.pop("token_matrices", None)
    embeddings = inputs.pop("embeddings", None) or {}
    return evaluate_all(
        triples.filter(of_model),
        token_matrices=None if matrices is None else matrices.filter(of_model),
        embeddings={e: (s.filter(of_model), p.filter(of_model)) for e, (s, p) in embeddings.items()},
        **inputs,
    )


def compare_runs(summary: DataFrame, model_keys: list[str] | None = None) -> DataFrame:
    """Metric by model, from the one-row-per-model summary.

    Only metrics that the summary has are listed.
    """
    present = [m for m in METRICS if m in summary.columns]
    values = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in present])
    )
    return (
        summary.select("model_key", values.alias("v"))
        .select("model_key", "v.metric", "v.value")
        .groupBy("metric")
        .pivot("model_key", model_keys)
        .agg(F.first("value"))
    )


def loss_curve(log: DataFrame) -> DataFrame:
    """``(run, step, loss)`` in order; entries and runs without a loss are left out."""
    return log.filter(F.col("loss").isNotNull()).select("run", "step", "loss").orderBy("run", "step")
