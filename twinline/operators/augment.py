"""Token-level augmentation with repeatable draws, inside Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.columns import FEATURES, SL, SOURCE, TARGET
from twinline.functions.text import BENGALI, let, uniform, words
from twinline.operators.features import feature_columns

SALTS = 16


def _pick_at(seed: int, key: Column, op: str, n: Column) -> Column:
    """A position from 0 to n - 1."""
    return F.floor(uniform(seed, key, op) * n).cast("int")


def adjacent_swap(tokens: Column, key: Column, probability: float, seed: int = 42) -> Column:
    """With the given probability swap one random pair of neighbours."""

    def swapped(ts: Column) -> Column:
        def at(i):
            return F.transform(
                ts,
                lambda t, j: F.when(j == i, F.get(ts, i + 1)).when(j == i + 1, F.get(ts, i)).otherwise(t),
            )

        due = (F.size(ts) >= 2) & (uniform(seed, key, "swap") < probability)
        return F.when(due, let(_pick_at(seed, key, "swap_at", F.size(ts) - 1), at)).otherwise(ts)

    return let(tokens, swapped)


def random_delete(
    tokens: Column, key: Column, probability: float, min_tokens: int = 3, seed: int = 42
) -> Column:
    """With the given probability drop one random token of more than ``min_tokens``."""

    def shortened(ts: Column) -> Column:
        def without(i):
            return F.filter(ts, lambda t, j: j != i)

        due = (F.size(ts) > min_tokens) & (uniform(seed, key, "delete") < probability)
        return F.when(due, let(_pick_at(seed, key, "delete_at", F.size(ts)), without)).otherwise(ts)

    return let(tokens, shortened)


def _drawn(key: Column, position: Column, probability: float, seed: int) -> Column:
    return uniform(seed, key, "synonym", position) < probability


def _choice(alternatives: Column, key: Column, position: Column, seed: int) -> Column:
    u = uniform(seed, key, "choice", position)
    return F.get(alternatives, F.floor(u * F.size(alternatives)).cast("int"))


def synonym_replace(
    df: DataFrame,
    synonyms: DataFrame,
    probability: float,
    seed: int = 42,
    key: str = SL,
    tokens: str = "tokens",
) -> DataFrame:
    """Replace each token of the array column, with the given probability, by
    one of its alternatives; tokens without any stay.

    ``synonyms`` is ``(token, alternatives ARRAY<STRING>)`` with distinct tokens, of
    any size; null tokens are ignored. Only the drawn tokens are exploded and joined;
    they come back as a map from position to replacement.
    """
    row_key = F.col(key)
    # Equal key and tokens mean equal draws, so this names a row well enough.
    # JSON tells nulls and the borders of key and tokens apart.
    df = df.withColumn("_row", F.md5(F.to_json(F.struct(row_key.alias("key"), F.col(tokens).alias("tokens")))))
    drawn = F.filter(
        F.transform(tokens, lambda t, i: F.struct(i.alias("position"), t.alias("token"))),
        lambda s: _drawn(row_key, s["position"], probability, seed),
    )
    wanted = (
        df.select("_row", row_key.alias("_key"), F.explode(drawn).alias("d"))
        .select("_row", "_key", "d.position", "d.token")
        .withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        .distinct()
    )
    # A frequent token is spread over the salts; the table is repeated for them.
    offered = synonyms.filter(F.col("token").isNotNull() & (F.size("alternatives") > 0)).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    )
    found = (
        wanted.join(offered, ["token", "salt"])
        .select(
            "_row",
            F.struct("position", _choice(F.col("alternatives"), F.col("_key"), F.col("position"), seed).alias("to")).alias("e"),
        )
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list("e")).alias("_found"))
    )
    return (
        df.join(found, "_row", "left")
        .withColumn(
            tokens,
            F.when(F.col("_found").isNull(), F.col(tokens)).otherwise(
                F.transform(tokens, lambda t, i: F.coalesce(F.element_at("_found", i), t))
            ),
        )
        .drop("_row", "_found")
    )


def _with_augmented(
    df: DataFrame,
    synonyms: DataFrame | None = None,
    synonym_prob: float = 0.10,
    swap_prob: float = 0.05,
    deletion_prob: float = 0.05,
    min_tokens: int = 3,
    seed: int = 42,
    text: str = SOURCE,
    key: str = SL,
) -> DataFrame:
    """Add the column ``_augmented``."""
    columns = df.columns
    df = df.withColumn("_tokens", words(F.col(text))).withColumn("_count", F.size("_tokens"))
    if synonyms is not None and synonym_prob > 0:
        df = synonym_replace(df, synonyms, synonym_prob, seed, key, "_tokens")
    edited = adjacent_swap(F.col("_tokens"), F.col(key), swap_prob, seed)
    edited = random_delete(edited, F.col(key), deletion_prob, min_tokens, seed)
    # An empty text has no tokens, which must not count as enough of them.
    long_enough = (F.col("_count") >= min_tokens) & (F.length(text) > 0)
    augmented = F.when(long_enough, F.array_join(edited, " ")).otherwise(F.col(text))
    return df.select(*columns, augmented.alias("_augmented"))


def augment_text(df: DataFrame, synonyms: DataFrame | None = None, text: str = SOURCE, **options) -> DataFrame:
    """Synonyms, then one swap, then one deletion, each by its probability.

    Null or empty text and text of fewer than ``min_tokens`` tokens stay as they
    are. Other text comes back joined by single blanks. Options are
    ``synonym_prob``, ``swap_prob``, ``deletion_prob``, ``min_tokens``, ``seed``
    and ``key``, the column that names a row for the draws.
    """
    augmented = _with_augmented(df, synonyms, text=text, **options)
    return augmented.withColumn(text, F.col("_augmented")).drop("_augmented")


def augment_train(
    df: DataFrame,
    synonyms: DataFrame | None = None,
    text: str = SOURCE,
    target: str = TARGET,
    script: str = BENGALI,
    **options,
) -> DataFrame:
    """The rows and an augmented copy of each, told apart by ``is_augmented``.

    Features that the table has are computed anew for the copies. Each row is
    read once and emitted twice.
    """
    featured = all(c in df.columns for c in FEATURES)
    rows = _with_augmented(df, synonyms, text=text, **options)
    changed = {text: F.col("_augmented")}
    if featured:
        rows = rows.withColumns({f"_{c}": f for c, f in feature_columns("_augmented", target, script).items()})
        changed |= {c: F.col(f"_{c}") for c in FEATURES}
    original = F.struct(*[F.col(c) for c in df.columns], F.lit(False).alias("is_augmented"))
    copy = F.struct(*[changed.get(c, F.col(c)).alias(c) for c in df.columns], F.lit(True).alias("is_augmented"))
    return rows.select(F.inline(F.array(original, copy)))
