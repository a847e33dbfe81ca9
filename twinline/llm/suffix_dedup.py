"""Removal of byte strings that are found earlier, by intervals of a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a
document of smaller id or further up in the same one. All equal strings have the same
*minimizer*, the least hash of the short grams inside, so strings are compared only
with those of the same minimizer, and a minimizer that is found once is dropped at once.
A minimizer that stands in very many different places (a line that many texts share) parts
its strings further, by a hash of the whole string, and those found once are dropped too.

What is compared in one task is cut out, put together, and sorted into a suffix array.
Its common prefixes are then derived in order of their length: going backwards through
the transform, a boundary between two suffixes with a common prefix of n - 1 bytes makes
a boundary with n bytes between the next suffixes that are preceded by the same byte.
The expansion stops at ``length``: boundaries it never reached part suffixes that share
``length`` bytes or more, so what lies between reached ones is a set of equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from twinline.llm import repeats
from twinline.llm.flat import BYTE_DRAW, buckets, chunks, dealt, flat, lean, mix, run_lengths, runs, span_hash, unpacked
from twinline.session import ship

# Bytes of a gram, and bytes of text that are sorted at once (a single minimizer's may be more).
GRAM = 32
SORTED_BYTES = 1 << 17
# Different segments from which on a minimizer's strings are dealt one by one, and the share of
# documents (one in so many) in which they are counted. Both only steer the cost.
HOT_SEGMENTS, SAMPLED = 10_000, 16

SEGMENT_ROWS = "bucket int, texts binary, sizes binary, keys binary, docs binary, starts binary, known binary"
LOW = np.uint64(255)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of ``gram`` bytes (a power of two), by joining halves."""
    h, width = BYTE_DRAW[data], 1
    while width < gram:
        h = mix(h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]) if width == 1 else (
            h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        )
        width *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(29))


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each string of ``length`` bytes inside one row: start, row, minimizer's place and hash.

    Of equal grams the leftmost counts, so equal strings have theirs at the same offset.
    The low bits of a hash are replaced by the place, modulo 256; where that wraps around
    inside a string, places are counted from half way.
    """
    spots = length - gram + 1
    if not 1 <= spots <= 128:
        raise ValueError("length must be 0 to 127 bytes above the gram")
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _gram_hashes(data, gram) & ~LOW
    place = np.arange(len(h), dtype=np.uint64)
    plain, shifted = _sliding_min(h | (place & LOW), spots), _sliding_min(h | ((place + np.uint64(128)) & LOW), spots)
    stop = np.repeat(offsets[1:], np.diff(offsets))[: len(plain)]
    starts = np.flatnonzero(stop - np.arange(len(plain)) >= length)
    wraps = (starts & 255) + spots > 256
    least = np.where(wraps, shifted[starts], plain[starts])
    counted = starts + 128 * wraps
    places = starts + (((least & LOW).astype(np.int64) - counted) & 255)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, rows, places, least & ~LOW


def _sliding_min(values: np.ndarray, spots: int) -> np.ndarray:
    width = 1
    while 2 * width <= spots:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = spots - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _anchor_runs(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where, along the strings, the minimizer changes."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (places[1:] != places[:-1])
    return np.flatnonzero(new)


def suffix_array(codes: np.ndarray, to_stop: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by ``depth`` codes at least; ties beyond stay in any order.

    ``codes`` are 1 to 256, and 0 for separators, which all differ and sort by place.
    ``to_stop`` tells how far the next separator is.
    """
    n, width = len(codes), 7
    code = np.zeros(n + 8, np.uint64)
    code[:n] = codes
    two = code[:-1] << np.uint64(9) | code[1:]
    four = two[:-2] << np.uint64(18) | two[2:]
    three = two[:-1] << np.uint64(9) | code[2:]
    key = (four[:n] << np.uint64(27)) | three[4 : n + 4]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (to_stop[order][1:] < width)
    first = np.flatnonzero(new)
    rank = np.empty(n + depth + 8, np.int64)
    rank[n:] = 0
    size = run_lengths(first, n)
    rank[order] = np.repeat(first, size)  # a group's rank is where it begins
    tied = order[np.repeat(size > 1, size)]
    while width < depth and len(tied):
        key = (rank[tied].astype(np.uint64) << np.uint64(32)) | rank[tied + width].astype(np.uint64)
        tied = tied[(by := np.argsort(key, kind="stable"))]
        key = key[by]
        group, part = runs(key >> np.uint64(32)), runs(key)
        sizes = run_lengths(part, len(tied))
        ahead = part - group[np.searchsorted(group, part, "right") - 1]
        rank[tied] = np.repeat(rank[tied[part]] + ahead, sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        width *= 2
    return np.argsort(rank[:n], kind="stable")


def boundaries(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares fewer than ``length`` bytes with the one before it.

    Threshold-bounded expansion: ``reached`` holds the boundaries found so far. Two
    suffixes that follow each other among those preceded by the same byte stay a pair
    until a boundary lies between them; then the suffixes one byte longer, which are
    neighbours, are parted by a boundary of one byte more.
    """
    n = len(codes)
    before = codes[order - 1].astype(np.int64)
    stops = before == 0
    before = np.where(stops, order, before + n)  # separators all differ
    by_byte = np.argsort(before, kind="stable")
    reached = np.ones(n, bool)
    reached[1:] = before[by_byte][1:] != before[by_byte][:-1]
    pairs = np.flatnonzero(~reached).astype(np.int32)
    left, right = by_byte[pairs - 1].astype(np.int32), by_byte[pairs].astype(np.int32)
    for _ in range(1, length):
        seen = np.cumsum(reached, dtype=np.int32)
        parted = seen[left] != seen[right]
        if not parted.any():
            break
        reached[pairs[parted]] = True
        pairs, left, right = pairs[~parted], left[~parted], right[~parted]
    return reached


def found_earlier(texts: bytes, sizes: np.ndarray, length: int) -> np.ndarray:
    """Places of ``texts`` (segments one after the other) whose next ``length`` bytes, in
    the same segment, also stand at a smaller place. True or false for every byte."""
    n = len(texts) + len(sizes)
    stops = np.cumsum(sizes + 1) - 1
    inside = np.ones(n, bool)
    inside[stops] = False
    codes = np.zeros(n, np.int16)
    codes[inside] = np.frombuffer(texts, np.uint8).astype(np.int16) + 1
    to_stop = np.repeat(stops, sizes + 1) - np.arange(n)
    order = suffix_array(codes, to_stop, length)
    group = np.cumsum(boundaries(codes, order, length)) - 1
    whole = to_stop >= length
    earliest = np.full(group[-1] + 1, n)
    np.minimum.at(earliest, group[whole[order]], order[whole[order]])
    again = np.zeros(n, bool)
    again[order] = earliest[group] < order
    return (again & whole)[inside]


def _true_runs(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true flags, which end at ``edges`` too."""
    cut = np.zeros(len(flags) + 1, bool)
    cut[edges] = True
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | cut[1:-1]
    ends[:-1] &= ~flags[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _compare(texts: list[bytes], keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple]:
    """(doc, start, stop) of the strings found earlier, of distinct segments."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    by_key = np.argsort(keys, kind="stable")
    first = runs(keys[by_key])
    volume = np.cumsum(np.add.reduceat(sizes[by_key], first)) // SORTED_BYTES
    for block in np.split(by_key, first[1:][volume[1:] != volume[:-1]]):
        # In order of document and start, so that a smaller place is an earlier one.
        block = block[np.lexsort((starts[block], docs[block]))]
        begins = np.concatenate(([0], np.cumsum(sizes[block])))
        flags = found_earlier(b"".join([texts[i] for i in block.tolist()]), sizes[block], length)
        a, b = _true_runs(flags, begins[1:-1])
        at = np.searchsorted(begins, a, "right") - 1
        shift = starts[block][at] - begins[at]
        yield docs[block][at], a + shift, b + shift


def hot_minimizers(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Minimizers of many different segments, sorted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.uint64)]
            for _, data, offsets in chunks(batch.column("text")):
                at, rows, places, least = minimizers(data, offsets, length, gram)
                if not len(at):
                    continue
                first = _anchor_runs(rows, places)
                last = np.concatenate((first[1:], [len(at)])) - 1
                texts = span_hash(BYTE_DRAW[data], at[first], at[last] + length)
                found.append(np.unique(np.column_stack((least[first], texts)), axis=0))
            both = np.unique(np.concatenate(found), axis=0).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(both[:, 0]), "segment": pa.array(both[:, 1])})

    some = docs.filter("doc_id is not null and text is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    seen = some.select("text").mapInArrow(scan, "key long, segment long").distinct()
    hot = seen.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, HOT_SEGMENTS // SAMPLED)).select("key")
    return np.sort(hot.toArrow().column("key").to_numpy().view(np.uint64))


def segments(docs: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """Texts that hold what may be repeats, dealt to buckets by minimizer (or string, if that is hot)."""
    count = buckets(docs)
    hot = hot_minimizers(docs, length, gram)

    def strings_of(data, offsets):
        at, rows, _, keys = minimizers(data, offsets, length, gram)
        take = repeats.is_in(keys, hot)
        if not take.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return rows[take], span_hash(BYTE_DRAW[data], at[take], at[take] + length)

    def keys_of(data, offsets):
        _, rows, places, keys = minimizers(data, offsets, length, gram)
        first = _anchor_runs(rows, places)
        return rows[first], keys[first]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("keys")))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            seen: dict[bytes, int] = {}
            texts, keys, docs_, starts, again = [], [], [], [], []
            for row, data, offsets in chunks(batch.column("text")):
                at, rows, places, least = minimizers(data, offsets, length, gram)
                if not len(at):
                    continue
                known = repeats.marked(batch, row, row + len(offsets) - 1)
                first = _anchor_runs(rows, places)
                last = np.concatenate((first[1:], [len(at)])) - 1
                split = repeats.is_in(least[first], hot)
                alone = np.flatnonzero(np.repeat(split, last - first + 1))
                take = repeats.is_in(repeats.joined(rows[first], least[first]), known) & ~split
                first, last = first[take], last[take]
                key_of = least[first]
                if len(alone):
                    # A string of a hot minimizer is a segment of its own, under its own hash.
                    strings = span_hash(BYTE_DRAW[data], at[alone], at[alone] + length)
                    doubled = repeats.marked(batch, row, row + len(offsets) - 1, "_strings")
                    take = repeats.is_in(repeats.joined(rows[alone], strings), doubled)
                    first, last = np.concatenate((first, alone[take])), np.concatenate((last, alone[take]))
                    key_of = np.concatenate((key_of, strings[take]))
                raw = data.tobytes()
                new = [raw[a:b] for a, b in zip(at[first].tolist(), (at[last] + length).tolist())]
                owner = ids[rows[first] + row]
                begin = at[first] - offsets[rows[first]]
                for text, key, doc, start in zip(new, key_of.tolist(), owner.tolist(), begin.tolist()):
                    other = seen.setdefault(text, len(texts))
                    if other == len(texts):
                        texts.append(text), keys.append(key), docs_.append(doc), starts.append(start)
                        continue
                    # Of equal segments only the earliest is compared; all of a later one is a repeat.
                    if (doc, start) < (docs_[other], starts[other]):
                        docs_[other], doc = doc, docs_[other]
                        starts[other], start = start, starts[other]
                    if (doc, start) != (docs_[other], starts[other]):
                        again.append((doc, start, start + len(text) - length + 1))
            if not texts:
                continue
            sizes = np.fromiter(map(len, texts), np.int32, len(texts))
            key = np.array(keys, np.uint64)
            bucket = (mix(key) % np.uint64(count)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            packed = dealt(
                bucket[order],
                {
                    "sizes": sizes[order],
                    "keys": key[order],
                    "docs": np.array(docs_, np.int64)[order],
                    "starts": np.array(starts, np.int64)[order],
                },
            )
            joined = [texts[i] for i in order.tolist()]
            first = runs(bucket[order])
            stops = [*first[1:].tolist(), len(order)]
            bodies = pa.array([b"".join(joined[a:b]) for a, b in zip(first.tolist(), stops)], pa.binary())
            yield _segment_batch(packed, bodies)
            if again:
                whole = np.array(again, np.int64)
                bucket = (mix(whole[:, 0].astype(np.uint64)) % np.uint64(count)).astype(np.int32)
                yield _known_batch(dealt(bucket, {"known": whole}))

    marked = repeats.with_repeated_keys(docs, repeats.repeated_keys(docs, keys_of, across=False))
    if len(hot):
        strings = repeats.repeated_keys(docs, strings_of, across=False).withColumnRenamed("keys", "_strings")
        marked = marked.join(strings, "doc_id", "left")
    else:
        marked = marked.withColumn("_strings", F.lit(None).cast("array<long>"))
    return marked.mapInArrow(lean(cut), SEGMENT_ROWS)


def repeated_runs(docs: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start, stop)``: runs of starts whose next ``length`` bytes are found earlier."""

    def match(table: pa.Table) -> pa.Table:
        known = unpacked(table, "known", "i8").reshape(-1, 3)
        body = b"".join(x or b"" for x in table.column("texts").to_pylist())
        sizes = unpacked(table, "sizes", "i4")
        keys, docs_, starts = unpacked(table, "keys", "u8"), unpacked(table, "docs", "i8"), unpacked(table, "starts", "i8")
        found = [(known[:, 0], known[:, 1], known[:, 2])]
        if len(sizes):
            stops = np.cumsum(sizes, dtype=np.int64)
            order = np.lexsort((starts, docs_))
            seen: dict[bytes, int] = {}
            kept, again = [], []
            for i in order.tolist():
                text = body[stops[i] - sizes[i] : stops[i]]
                first = seen.setdefault(text, i)
                if first == i:
                    kept.append(i)
                elif (docs_[first], starts[first]) != (docs_[i], starts[i]):
                    again.append(i)
            again = np.array(again, np.int64)
            found.append((docs_[again], starts[again], starts[again] + sizes[again] - length + 1))
            kept = np.array(kept, np.int64)
            found.extend(_compare(list(seen), keys[kept], docs_[kept], starts[kept], length))
        doc, start, stop = (np.concatenate(x) for x in zip(*found))
        return pa.table({"doc_id": doc, "start": start, "stop": stop})

    return segments(docs, length, gram).groupBy("bucket").applyInArrow(lean(match), "doc_id long, start long, stop long")


_SEGMENT_NAMES = ("bucket", "texts", "sizes", "keys", "docs", "starts", "known")


def _segment_batch(packed: pa.RecordBatch, bodies: pa.Array) -> pa.RecordBatch:
    columns = {n: packed.column(n) for n in packed.schema.names} | {"texts": bodies}
    columns["known"] = pa.array([b""] * len(bodies), pa.binary())
    return pa.RecordBatch.from_arrays([columns[n] for n in _SEGMENT_NAMES], names=list(_SEGMENT_NAMES))


def _known_batch(packed: pa.RecordBatch) -> pa.RecordBatch:
    nothing = pa.array([b""] * packed.num_rows, pa.binary())
    columns = {n: packed.column(n) if n in ("bucket", "known") else nothing for n in _SEGMENT_NAMES}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def remove_repeats(
    df: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM
) -> DataFrame:
    """``df`` with n_bytes, n_removed, spans removed (start and stop bytes, flat) and kept bytes.

    Id and text are named doc_id and text; columns that clash with any of these are replaced. One row for each row of ``df``. Strings are judged on the input, not on what is left,
    and never cross documents. A null text is empty; shorter texts stay whole. A null
    doc_id takes no part and stays whole. Repeated rows are one document and don't remove
    each other; an empty table gives an empty one.
    """
    ship(df.sparkSession)
    made = [
        StructField("n_bytes", LongType()),
        StructField("n_removed", LongType()),
        StructField("spans", ArrayType(LongType())),
        StructField("kept", BinaryType()),
    ]
    # All columns go along from the first join on, so that both joins share a shuffle.
    docs = repeats.documents(df, doc_id, text, tuple(f.name for f in made))
    schema = StructType([*docs.schema, *made])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            sizes, removed, spans, kept = [], [], [], []
            for i, found in enumerate(batch.column("runs")):
                body = data[offsets[i] : offsets[i + 1]]
                sizes.append(len(body))
                gone = np.zeros(len(body), bool)
                if found.is_valid:
                    gone = repeats.covered(len(body), found.values.to_numpy(zero_copy_only=False), length)
                a, b = _true_runs(gone, np.zeros(0, np.int64))
                removed.append(int(gone.sum()))
                spans.append(np.column_stack((a, b)).ravel())
                kept.append(body[~gone].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            new = [pa.array(x, kind) for x, kind in zip((sizes, removed, spans, kept), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in docs_columns), *new], names=schema.names)

    docs_columns = docs.columns
    return repeats.with_runs(docs, repeated_runs(docs, length, gram)).mapInArrow(lean(apply), schema)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def whole_characters(kept: str) -> Column:
    """Kept bytes as text, without the characters of which a byte is gone."""
    # Bytes that are no character any more become the replacement character;
    # texts that hold one of their own lose it where something is cut.
    return F.replace(F.make_valid_utf8(F.col(kept).cast("string")), F.lit("\ufffd"), F.lit(""))
