"""Exact and near-duplicate removal, and the similarity self-join.

Near-duplicates are rows whose source token sets have a Jaccard similarity of at
least ``min_similarity`` with a row of lower id. Rows with equal token sets are
first folded into one set with its lowest id, so copies never meet each other:
a copy is dropped because its id is not the lowest. What is left are distinct
sets, and a set's lowest id is dropped if a similar set has a lower one.

Candidates share a *block key*. The exact way orders tokens by document frequency, the
rarest first, and files the first tokens of each set, as many as a similar set of a given
size can lack and one more: similar sets share one of those. So frequent words and
passages that many rows share come last and bring nothing together. The LSH way bands
MinHash values. Both go through the same exact check of token sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.columns import ID, SL, SOURCE, TARGET
from twinline.operators.components import connected_classes, summed_links
from twinline.operators.known import maybe_in
from twinline.session import ship, written

# Members of a block that one task compares with each other before it is split.
BLOCK_ROWS = 4096
# Members of a block up to which pairs that can be similar are rows, so many for each at most.
PAIR_ROWS = 32


def pair_hash(source: str | Column = SOURCE, target: str | Column = TARGET) -> Column:
    return F.sha2(F.concat_ws("||", source, target), 256)


def exact_dedup(df: DataFrame, source: str = SOURCE, target: str = TARGET) -> DataFrame:
    """Keep the row of lowest id for each pair of texts.

    Spark limits each key to one row per task before the shuffle
    (WindowGroupLimit), so a pair that fills a third of the table is no hot key.
    """
    first = Window.partitionBy(pair_hash(source, target)).orderBy(ID, SL, source, target)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def anti_join(df: DataFrame, ids: DataFrame, id_column: str = ID) -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids``; a null id is always kept.

    Null ids stay out of the join, where they would all be one key's rows.
    """
    known = df.filter(F.col(id_column).isNotNull())
    kept = known.join(ids.filter(F.col(id_column).isNotNull()).select(id_column), id_column, "left_anti")
    return kept.select(*df.columns).union(df.filter(F.col(id_column).isNull()))


# --- token sets and block keys -------------------------------------------------


def _tokens(text: str) -> Column:
    return F.sort_array(F.array_distinct(F.split(F.lower(text), r"\s")))


def _set_hash(tokens: Column) -> Column:
    # Never null, or the join would test the whole expression for null first.
    return F.coalesce(F.unhex(F.md5(F.array_join(tokens, " "))), F.lit(b""))


def token_sets(df: DataFrame, text: str = SOURCE, id_column: str = ID) -> DataFrame:
    """Distinct lower-cased token sets as ``(tokens, rep, copies)``: the lowest id, and of how many rows.

    They are shuffled as texts, a fraction of an array's size. Tokens hold no blank.
    """
    return (
        df.filter(F.col(id_column).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.array_join(_tokens(text), " ").alias("tokens"))
        .agg(F.min(F.col(id_column).cast("long")).alias("rep"), F.count("*").alias("copies"))
        .withColumn("tokens", F.split("tokens", " "))
    )


def copies_of_sets(df: DataFrame, sets: DataFrame, text: str = SOURCE, id_column: str = ID) -> DataFrame:
    """Rows whose token set has a lower id, as ``(rep, copy)``.

    The rows carry a hash in place of their tokens. Sets are unique, so only the
    rows can be skewed on it, and AQE splits such a partition.
    """
    rows = df.filter(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_column).alias("copy"), _set_hash(_tokens(text)).alias("set_hash")
    )
    lowest = sets.select("rep", _set_hash(F.sort_array("tokens")).alias("set_hash"))
    return rows.join(lowest, "set_hash").filter("copy > rep").select("rep", "copy")


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


# Groups of tokens, by hash, whose frequencies order them.
FREQUENCIES = 1 << 17


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets tokens of each group of hashes occur: a table of fixed size.

    A rare token in a frequent one's group is filed later than it might be, which costs a
    little and loses nothing: any order does, as long as it is the same for all sets.
    """
    group = F.pmod(F.xxhash64("token"), F.lit(FREQUENCIES)).cast("int")
    told = sets.select(F.explode("tokens").alias("token")).groupBy(group.alias("at")).agg(F.count("*").alias("n"))
    counts, rows = np.zeros(FREQUENCIES, np.int64), told.toArrow()
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return counts


def rarest_first(sets: DataFrame) -> DataFrame:
    """``sets`` with the tokens of each in the common order, and their ``hashes``."""
    others = [c for c in sets.columns if c != "tokens"]
    counts = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, hashes = batch.column("tokens"), batch.column("hashes")
            sizes = pc.list_value_length(hashes).to_numpy()
            flat = hashes.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, counts.value[flat % FREQUENCIES], row))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in others),
                    pa.ListArray.from_arrays(offsets, tokens.flatten().take(pa.array(order))),
                    pa.ListArray.from_arrays(offsets, pa.array(flat[order])),
                ],
                [*others, "tokens", "hashes"],
            )

    hashed = sets.select(*others, "tokens", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    return hashed.mapInArrow(scan, hashed.schema)


def prefix_keys(ordered: DataFrame, min_similarity: float) -> DataFrame:
    """Block keys ``(rep, key, side, room, short, size, bits)``, of which two sets with Jaccard >= ``min_similarity`` share one.

    Similar sets of n and m tokens share a = (n + m) t / (1 + t) of them at least, so the
    first n - a + 1 tokens of the one and the first m - a + 1 of the other have one in common.
    A set files the prefix for the smallest partner it can have, and ``short`` tells those
    of its keys that also lie in the prefix for partners of its size or more: of two similar
    sets, the smaller one's common key is short. ``room`` is how many tokens are left from
    this one on: if it is the first that is common, no more can be, so ``room`` decides
    which prefix of two given sizes the key is in. ``size`` and ``bits`` are those of the set.
    Keys have no sides (``side`` is 0). Sizes at which only equal sets are similar have no
    keys, as equal sets are folded.
    """
    t = min_similarity
    if not 1 / 3 < t <= 1:
        raise ValueError("min_similarity must lie above 1/3, at most at 1")
    ship(ordered.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, lists = batch.column("rep").to_numpy(), batch.column("hashes")
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            if not len(n):
                continue
            flat, starts = lists.flatten().to_numpy(), np.cumsum(n) - n
            least, most = np.ceil(n * t - 1e-9), np.floor(n / t + 1e-9)

            def shared(m: np.ndarray) -> np.ndarray:
                return np.ceil((n + m) * (t / (1 + t)) - 1e-9)

            # Partners of its size or more, and of any size: the smallest, or 0.
            upward = np.where(shared(n) < n, n, np.where(most > n, n + 1, 0))
            smallest = np.where(least < n, least, upward)
            length, short = (np.where(m > 0, n - shared(m) + 1, 0).astype(np.int64) for m in (smallest, upward))
            row = np.repeat(np.arange(len(n)), length)
            at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": rep[row],
                    "key": flat[starts[row] + at],
                    "side": np.zeros(len(row), np.int32),
                    "room": (n[row] - at).astype(np.int32),
                    "short": at < short[row],
                    "size": n[row].astype(np.int32),
                    "bits": bitmaps(flat, starts)[row],
                }
            )

    return ordered.select("rep", "hashes").mapInArrow(
        scan, "rep long, key long, side int, room int, short boolean, size int, bits long"
    )


def bitmaps(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One bit per token, by hash, in a 64-bit number for each set."""
    return np.bitwise_or.reduceat(np.uint64(1) << (flat.view(np.uint64) & np.uint64(63)), starts).view(np.int64)


# The least recall of a similar pair, and the most bands that may be spent on it.
RECALL, MOST_BANDS, MOST_ROWS = 0.99, 40, 8
# Draws are multiples of a token's number modulo this prime.
PRIME = 2147483647


def banding(min_similarity: float) -> tuple[int, int]:
    """Bands and values in each, so that a pair of just that similarity shares a band
    with a chance of RECALL; as many values as MOST_BANDS allows, which share less by chance."""
    for rows in range(MOST_ROWS, 0, -1):
        shared = min(min_similarity**rows, 1 - 1e-9)
        bands = math.ceil(math.log(1 - RECALL) / math.log(1 - shared))
        if bands <= MOST_BANDS or rows == 1:
            return bands, rows


def minhash_draws(count: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each draw, fixed by its number."""
    digests = [hashlib.md5(f"draw {k}".encode()).digest() for k in range(count)]
    return [
        (1 + int.from_bytes(d[:4], "big") % (PRIME - 1), int.from_bytes(d[4:8], "big") % PRIME) for d in digests
    ]


def minhash_keys(sets: DataFrame, bands: int, rows_per_band: int) -> DataFrame:
    """Block keys from banded MinHash values of the tokens' digests.

    ``bands=3, rows_per_band=1`` is the published number of tables.
    """
    number = F.transform("tokens", lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("bigint"))
    draws = minhash_draws(bands * rows_per_band)
    ship(sets.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("numbers")
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            if not len(n):
                continue
            numbers, starts = lists.flatten().to_numpy(), np.cumsum(n) - n
            least = np.stack([np.minimum.reduceat((numbers * a + b) % PRIME, starts) for a, b in draws], axis=1)
            offsets = pa.array(np.arange(len(n) + 1) * len(draws), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    pa.ListArray.from_arrays(offsets, pa.array(least.reshape(-1))),
                    pa.array(n.astype(np.int32)),
                    pa.array(bitmaps(batch.column("hashes").flatten().to_numpy(), starts)),
                ],
                ["rep", "least", "size", "bits"],
            )

    hashes = F.transform("tokens", lambda x: F.xxhash64(x))
    drawn = sets.select("rep", number.alias("numbers"), hashes.alias("hashes")).mapInArrow(
        scan, "rep long, least array<long>, size int, bits long"
    )
    values = [F.get("least", F.lit(i)) for i in range(bands * rows_per_band)]
    keys = [F.xxhash64(F.lit(i), *values[i * rows_per_band : (i + 1) * rows_per_band]) for i in range(bands)]
    # Bands say nothing about sizes or places.
    return drawn.select(
        "rep", F.explode(F.array(*keys)).alias("key"), F.lit(0).alias("side"), F.col("size").alias("room"), F.lit(True).alias("short"), "size", "bits"
    )


# --- from block keys to decisions ----------------------------------------------


def _members(keys: DataFrame) -> DataFrame:
    """Keys that sets share: ``(key, rep, room, size, bits, members, lowest)``.

    Most keys of a real corpus are filed by one set, or by none as a short one. They are
    thrown out. What is left is written out, as it is read several times.
    """
    counts = (
        keys.groupBy("key")
        .agg(F.count("*").cast("int").alias("members"), F.min("rep").alias("lowest"), F.max("short").alias("any_short"))
        .filter("members > 1 and any_short")
        .drop("any_short")
    )
    return written(keys.select("key", "rep", "room", "size", "bits").join(counts, "key"), "members")


def _with_tokens(sets: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(maybe_in(sets, members, "rep"), "rep")


def _blocks(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """Sets that share a key: its members and their tokens."""
    return _with_tokens(sets, _members(keys))


def _possible_pairs(members: DataFrame, min_similarity: float) -> DataFrame:
    """``(rep, other, key)`` of blocks of up to PAIR_ROWS: two sets that can be similar, the lower one as ``other``."""
    small = members.filter(F.col("members") <= PAIR_ROWS).drop("members", "lowest")
    met = (F.col("p.key") == F.col("b.key")) & (F.col("b.rep") < F.col("p.rep")) & _possible("p", "b", min_similarity)
    return small.alias("p").join(small.alias("b"), met).select(F.col("p.rep").alias("rep"), F.col("b.rep").alias("other"), "p.key")


def _similar_pairs(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """Those of ``pairs`` that are similar by their tokens, with ``p`` and ``b``, the rows of both sets.

    Tokens travel as texts, a fraction of an array's size.
    """
    ends = pairs.select("rep").union(pairs.select(F.col("other").alias("rep")))
    texts = maybe_in(sets, ends, "rep").withColumn("tokens", F.array_join("tokens", " "))
    others = [c for c in sets.columns if c not in ("rep", "tokens")]

    def side(rep: str, name: str) -> DataFrame:
        return texts.select(F.col("rep").alias(rep), F.struct("tokens", *others).alias(name))

    def split(name: str) -> Column:
        tokens = F.split(F.col(name)["tokens"], " ")
        return F.struct(tokens.alias("tokens"), F.size(tokens).alias("size"), *[F.col(name)[c].alias(c) for c in others])

    both = pairs.join(side("rep", "p"), "rep").join(side("other", "b"), "other")
    return both.withColumns({"p": split("p"), "b": split("b")}).filter(_similar("p", "b", min_similarity))


def _large(members: DataFrame) -> DataFrame:
    return members.filter(F.col("members") > PAIR_ROWS)


def _spread(probe: DataFrame, build: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split large blocks: deal the build side over salts, repeat the probe side.

    A block within ``BLOCK_ROWS`` has one salt. Each build row lands on one salt
    and each probe row meets all of them, so every comparison still happens.
    """
    salts = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    return (
        probe.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))),
        build.withColumn("salt", F.pmod(F.xxhash64("rep"), salts.cast("bigint")).cast("int")),
    )


def _dealt_as_texts(probe: DataFrame, build: DataFrame) -> list[DataFrame]:
    """Both sides spread and dealt out by block, their tokens as texts meanwhile."""
    return [
        side.withColumn("tokens", F.array_join("tokens", " ")).repartition("key", "salt").withColumn("tokens", F.split("tokens", " "))
        for side in _spread(probe, build)
    ]


def _together() -> Column:
    """Join condition: p and b are in one block and meet in it."""
    return (F.col("p.key") == F.col("b.key")) & (F.col("p.salt") == F.col("b.salt"))


def _needed(a: str, b: str, min_similarity: float) -> Column:
    """How many tokens similar sets share: s / (n + m - s) >= t is s >= (n + m) t / (1 + t)."""
    return (F.col(f"{a}.size") + F.col(f"{b}.size")) * F.lit(min_similarity / (1 + min_similarity)) - 1e-9


def _possible(a: str, b: str, min_similarity: float) -> Column:
    """Whether two members of a block can be similar, by what is known without their tokens.

    n + m - 2s <= (n + m) (1 - t) / (1 + t) tokens are in one set only, and each bit that
    differs stands for at least one of those.
    """
    t = min_similarity
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    sizes = F.least(n, m) >= F.greatest(n, m) * t - 1e-9
    bits = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= (n + m) * ((1 - t) / (1 + t)) + 1e-9
    return sizes & (F.least(f"{a}.room", f"{b}.room") >= _needed(a, b, t)) & bits


def _similar(a: str, b: str, min_similarity: float) -> Column:
    """Whether two sets are similar, by their tokens."""
    return F.size(F.array_intersect(f"{a}.tokens", f"{b}.tokens")) >= _needed(a, b, min_similarity)


def filed_sets(sets: DataFrame, min_similarity: float, in_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """``sets``, with their tokens in order if asked for, and their keys, written as they are read again."""
    sets = written(sets, "sets")
    ordered = rarest_first(sets)
    keys = written(prefix_keys(ordered, min_similarity).drop("side"), "keys")
    return written(ordered.drop("hashes"), "ordered") if in_order else sets, keys


def _meets_lower(min_similarity: float) -> Column:
    """Join condition: b is in p's block, has a lower id, and can be similar."""
    return _together() & (F.col("b.rep") < F.col("p.rep")) & _possible("p", "b", min_similarity)


def _similar_to_lower(sets: DataFrame, keys: DataFrame, min_similarity: float) -> DataFrame:
    """Lowest ids of sets that resemble a set with a lower lowest id."""
    members = _members(keys)
    pairs = written(_possible_pairs(members, min_similarity).select("rep", "other").distinct(), "pairs")

    # Each set against the lowest one that it met in small blocks, and the lowest member of
    # large ones. That takes the bulk out of groups of near-copies.
    large = _large(members)
    others = large.filter("rep > lowest")
    lowest = large.filter("rep = lowest").drop("rep", "members")
    first = (
        others.alias("p")
        .join(lowest.alias("b"), F.col("p.key") == F.col("b.key"))
        .filter(_possible("p", "b", min_similarity))
        .select(F.col("p.rep").alias("rep"), F.col("b.lowest").alias("other"))
        .union(pairs.groupBy("rep").agg(F.min("other").alias("other")))
        .distinct()
    )
    first = written(first, "first")
    found = written(_similar_pairs(first, sets, min_similarity).select("rep").distinct(), "found")
    rest = written(pairs.join(first, ["rep", "other"], "left_anti").join(found, "rep", "left_anti"), "rest")
    found = written(found.union(_similar_pairs(rest, sets, min_similarity).select("rep")).distinct(), "found")

    # The others against the rest of their large blocks: first those that can be similar to one, by
    # sizes, places and bits, and then those by their tokens. A semi join stops at the first
    # similar set and emits a set at most once per key and salt, never pairs.
    build = others.drop("lowest")
    probe, dealt = _spread(build.join(found, "rep", "left_anti"), build)
    met = _meets_lower(min_similarity)
    open_ = written(probe.alias("p").join(dealt.alias("b"), met, "left_semi").drop("salt").distinct(), "open")
    probe, dealt = _spread(open_, build)
    wanted = written(dealt.alias("b").join(probe.alias("p"), met, "left_semi").drop("salt"), "wanted")
    probe, build = _dealt_as_texts(_with_tokens(sets, open_), _with_tokens(sets, wanted))
    similar = probe.alias("p").join(build.alias("b"), met & _similar("p", "b", min_similarity), "left_semi")
    return found.union(similar.select("rep")).distinct()


def near_duplicate_ids(
    df: DataFrame,
    min_similarity: float = 0.95,
    method: str = "exact",
    text: str = SOURCE,
    id_column: str = ID,
    **minhash: int,
) -> DataFrame:
    """Distinct ids of rows that resemble a row of lower id.

    Not transitive: a row is named even if the row it resembles is named too.
    """
    sets = token_sets(df, text, id_column)
    if method == "exact":
        sets, keys = filed_sets(sets, min_similarity, in_order=False)
    elif method == "lsh":
        bands, rows = banding(min_similarity)
        sets = written(sets, "sets")
        keys = minhash_keys(sets, minhash.get("bands", bands), minhash.get("rows_per_band", rows))
    else:
        raise ValueError(f"unknown method: {method}")
    copies = copies_of_sets(df, sets, text, id_column).select(F.col("copy").alias(id_column))
    similar = _similar_to_lower(sets, keys, min_similarity)
    return copies.union(similar).distinct()


def near_dup_exact(
    df: DataFrame, min_similarity: float = 0.95, text: str = SOURCE, id_column: str = ID
) -> DataFrame:
    """Drop near-duplicates of the source text, at recall 1."""
    return anti_join(df, near_duplicate_ids(df, min_similarity, "exact", text, id_column), id_column)


def near_dup_lsh(
    df: DataFrame, min_similarity: float = 0.95, text: str = SOURCE, id_column: str = ID, **minhash
) -> DataFrame:
    """Drop the near-duplicates that MinHash bands bring together.

    Candidates are checked on their real token sets, so this never drops a row
    that :func:`near_dup_exact` keeps. Bands follow from ``min_similarity``
    (:func:`banding`) unless ``bands`` and ``rows_per_band`` are given.
    """
    ids = near_duplicate_ids(df, min_similarity, "lsh", text, id_column, **minhash)
    return anti_join(df, ids, id_column)


def similarity_self_join(
    df: DataFrame, min_similarity: float = 0.95, text: str = SOURCE, id_column: str = ID
) -> DataFrame:
    """``(id, class_id, n_links, jaccard_dist)``, a row for each row of ``df``.

    Two rows link if their token sets have a Jaccard similarity of ``min_similarity`` or
    more. ``class_id`` is the lowest id that links reach, ``n_links`` how many rows the row
    is linked with, and ``jaccard_dist`` the distance of the nearest one (null without links).
    So no link is lost, and n near-copies give n rows in place of n(n-1)/2. Every pair
    of distinct sets is found once, at the first token of their prefixes that both have, and
    summed up in the task that finds it.

    A row without an id or a text links with nothing and is its own class. Rows are
    told apart even if they share an id: sets meet and are summed up by a number of their
    own, as different ones may have the same lowest id. Two classes then may, too.
    """
    ship(df.sparkSession)
    # Numbers are fixed once the sets are written, which filing them does first.
    numbered = token_sets(df, text, id_column).withColumnRenamed("rep", "lowest").withColumn("rep", F.monotonically_increasing_id())
    filed, keys = filed_sets(numbered, min_similarity)
    sets, lowest = filed.drop("lowest"), filed.select("rep", "lowest")
    members = _members(keys)

    # Pairs of small blocks are counted if the first token that both have is one of the keys
    # by which they met. If it is not, its block is a large one, and they are counted there.
    pairs = written(_possible_pairs(members, min_similarity).groupBy("rep", "other").agg(F.collect_set("key").alias("keys")), "pairs")
    common = F.array_intersect("p.tokens", "b.tokens")
    in_small = _similar_pairs(pairs, sets, min_similarity).filter(F.array_contains("keys", F.xxhash64(F.get(common, F.lit(0)))))

    # Members of large blocks that can resemble another one meet with their tokens.
    large = _large(members)
    probe, build = _spread(large, large)
    met = _together() & (F.col("p.rep") != F.col("b.rep")) & _possible("p", "b", min_similarity)
    blocks = _with_tokens(sets, written(probe.alias("p").join(build.alias("b"), met, "left_semi").drop("salt").distinct(), "possible"))
    probe, build = _dealt_as_texts(blocks, blocks)

    def before(side: str) -> Column:
        return F.slice(f"{side}.tokens", F.lit(1), F.col(f"{side}.size") - F.col(f"{side}.room"))

    in_large = probe.alias("p").join(
        build.alias("b"),
        _meets_lower(min_similarity) & _similar("p", "b", min_similarity) & ~F.arrays_overlap(before("p"), before("b")),
    )
    distance = (1 - _jaccard(F.col("p.tokens"), F.col("b.tokens"))).alias("distance")
    copies = F.col("p.copies").alias("copies_a"), F.col("b.copies").alias("copies_b")
    links = in_small.select(F.col("rep").alias("a"), F.col("other").alias("b"), *copies, distance).union(
        in_large.select(F.col("p.rep").alias("a"), F.col("b.rep").alias("b"), *copies, distance)
    )
    told = written(summed_links(links), "links")
    told_roots = told.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_classes(told_roots).select(F.col("node").alias("rep"), F.col("class_id").alias("root"))
    roots = written(roots.join(lowest, "rep"), "roots")
    # Both sides are tables, so that Spark can split the rows of a large class.
    classes = written(roots.groupBy("root").agg(F.min("lowest").alias("class_id")), "classes")
    linked = (
        told.groupBy(F.col("node").alias("rep"))
        .agg(F.sum("links").alias("links"), F.min("nearest").alias("nearest"))
        .join(roots.select("rep", "root").join(classes, "root").drop("root"), "rep")
    )
    of_sets = filed.select("rep", "lowest", "copies", _set_hash(F.sort_array("tokens")).alias("set_hash")).join(linked, "rep", "left")
    known = F.col(id_column).isNotNull() & F.col(text).isNotNull()
    ids = F.col(id_column).cast("long").alias("id")
    rows = df.filter(known).select(ids, _set_hash(_tokens(text)).alias("set_hash"))
    others = df.filter(~known).select(ids, ids.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("jaccard_dist"))
    return (
        rows.join(of_sets, "set_hash")
        .select(
            "id",
            F.coalesce("class_id", "lowest").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("copies") > 1, 0.0).otherwise(F.col("nearest")).alias("jaccard_dist"),
        )
        .union(others)
    )


def deduplicate(
    df: DataFrame, near_dup: str | None = None, min_similarity: float = 0.95, **minhash
) -> DataFrame:
    """Exact deduplication, then near-duplicates by ``near_dup`` if given.

    The near step reads its input several times, so the exact result is written
    to the shared folder first.
    """
    unique = exact_dedup(df)
    if near_dup is None:
        return unique
    unique = written(unique, "unique")
    return anti_join(unique, near_duplicate_ids(unique, min_similarity, near_dup, **minhash))
