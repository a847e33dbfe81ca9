"""Jaccard self-join of word n-grams, by T-occurrence search over inverted lists.

Two documents are similar only if they share T of their n-grams, so similarity search
asks which documents occur at least T times in the inverted lists of a document's grams.
DivideSkip answers it: the longest lists are set aside, the short ones are merged, and
documents that occur often enough there are looked up in the long lists by binary search.

Spark brings together what can be similar. Equal sets are folded to their smallest
document. A document files the first of its grams, as many as a similar set can lack and
one more, so similar sets file a common one, whatever the order of grams is. It is by
length, the longest first, as frequent words are short and long grams mostly unique, but
for the grams filed most often (``COMMON_GRAMS`` at most), which all come last. So a
passage that many documents share doesn't bring them together. Sets that share a filed hash and
whose sizes allow it are linked; the components of those links are the indexes in which
the search runs, many small ones to a task. In a large one, by sets or by grams, only grams that two of its
sets have are kept, and sets that have enough of them left to be similar to another. What is
still large is searched in pieces, then among the smallest of each class found, and last
only for sets that share a filed gram with a set of another class, so that neither side of
a search outgrows a task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.components import components
from twinline.llm.flat import buckets, chunks, dealt, flat, lean, mix, run_lengths, runs, unpacked, words
from twinline.llm.repeats import is_in
from twinline.session import ship, written

# Documents whose sets are held at once before they are sent on.
SLICE_ROWS = 500
# Bytes of text whose grams are made at once: some 100 bytes of memory for each.
TEXT_BYTES = 1 << 17
# Sets in the index of one search, and entries that are merged by a heap (more by sorting).
INDEX_SETS = 20_000
# Grams in the index of one search: 16 MB, and some 60 MB with what it takes to build it.
INDEX_GRAMS = 2_000_000
# Grams that are held at once before they are sent on.
HELD_GRAMS = 1 << 18
# A tile of a search is numbered block * SLICES + slice.
SLICES = 1 << 31
# Grams that come last in the order, at most (8 bytes each, sent to all tasks), and how often
# they are filed at least. Both only steer the cost: any order gives the same links.
COMMON_GRAMS = 500_000
COMMON_COUNT = 8
# Bits of the filter that keeps documents without a candidate from being shuffled.
FILTER_BITS, CHUNK_BITS = 1 << 25, 1 << 15
HEAP_ENTRIES = 400

PREFIX_ROWS = "bucket int, keys binary, docs binary, sizes binary, a binary, b binary"
GRAM_ROWS = "bucket int, told boolean, keys binary, sets binary, docs binary, sizes binary, often binary"


def gram_sets(column: pa.Array, grams: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the n-grams of lower-cased words) for each text.

    The first bits of a hash count down from the gram's length, so long grams come first.
    A text of fewer words has one gram, all of them; one without words has none.
    """
    # Rows are taken from the batch few at a time, so that no copy of all its texts is made.
    slices = (
        (at + row, data, offsets)
        for at in range(0, len(column), SLICE_ROWS)
        for row, data, offsets in chunks(column.slice(at, SLICE_ROWS), TEXT_BYTES)
    )
    for row, data, offsets in slices:
        names, rows, begins, ends = words(data, offsets, lower=True)
        size = np.concatenate(([0], np.cumsum(ends - begins)))
        first = np.searchsorted(rows, np.arange(len(offsets)))
        hashes = np.zeros(len(names), np.uint64)
        for k in range(grams):
            hashes[: len(names) - k] = mix(hashes[: len(names) - k] + names[k:])
        short = 255 - np.minimum(size[grams:] - size[: len(size) - grams], 255)
        hashes = (hashes[: len(short)] >> np.uint64(8)) | (short.astype(np.uint64) << np.uint64(56))
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= grams:
                yield row + i, np.unique(hashes[a : b - grams + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = mix(whole + names[k : k + 1])
                yield row + i, whole
            else:
                yield row + i, np.zeros(0, np.uint64)


def _similar(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def _least_overlap(n: int, percent: int) -> int:
    """The T of a set of ``n``: what any similar set shares with it at least."""
    return max(1, -(-n * percent // 100))


def _prefix(found: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first grams of a set in the global order, one more than a similar set can lack."""
    size = len(found) - _least_overlap(len(found), percent) + 1
    if not len(common):
        return found[:size]
    head = found[: 2 * size]
    late = is_in(head, common)
    if np.count_nonzero(~late) < size:
        head, late = found, is_in(found, common)
    return np.concatenate((head[~late], head[late]))[:size]


def common_grams(docs: DataFrame, grams: int, percent: int, most: int) -> np.ndarray:
    """The grams that most documents would file, sorted; counted over all documents."""
    count = buckets(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filed = [_prefix(found, percent, np.zeros(0, np.uint64)).copy() for _, found in gram_sets(batch.column("text"), grams) if len(found)]
            if filed:
                keys, counts = np.unique(np.concatenate(filed), return_counts=True)
                del filed
                yield dealt((mix(keys) % np.uint64(count)).astype(np.int32), {"keys": keys, "counts": counts.astype(np.int32)})

    def add(table: pa.Table) -> pa.Table:
        keys, counts = unpacked(table, "keys", "u8"), unpacked(table, "counts", "i4")
        order = np.argsort(keys)
        first = runs(keys[order])
        total = np.add.reduceat(counts[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        often = total >= COMMON_COUNT
        return pa.table({"key": keys[order][first][often].view(np.int64), "n": total[often]})

    rows = docs.filter("text is not null").select("text").mapInArrow(lean(scan), "bucket int, keys binary, counts binary")
    counted = rows.groupBy("bucket").applyInArrow(lean(add), "key long, n long")
    top = counted.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().view(np.uint64))


def fingerprints(docs: DataFrame, grams: int, percent: int, common: np.ndarray) -> DataFrame:
    """``(doc_id, n_shingles, fingerprint, prefix)`` for each row."""
    late = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, prefixes = [], [], []
            for _, found in gram_sets(batch.column("text"), grams):
                n = len(found)
                both = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)])
                sizes.append(n)
                prints.append(both.tobytes() if n else None)
                prefixes.append(_prefix(found, percent, late.value).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(prefixes, pa.binary())],
                names=["doc_id", "n_shingles", "fingerprint", "prefix"],
            )

    return docs.mapInArrow(lean(scan), "doc_id long, n_shingles long, fingerprint binary, prefix binary")


def _chained(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (doc, smallest of its group) of documents that share a key.

    A key's documents, sorted by size, fall apart where the next size is too large for
    the last one, as then no pair across can be similar.
    """
    order = np.lexsort((sizes, keys))
    keys, docs, sizes = keys[order], docs[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
    first = np.flatnonzero(new)
    if not len(first):
        return docs, docs
    least = np.repeat(np.minimum.reduceat(docs, first), run_lengths(first, len(docs)))
    return docs[docs != least], least[docs != least]


def candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` whose components hold all similar pairs of ``sets``."""
    count = buckets(sets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sizes = batch.column("n_shingles").to_numpy(zero_copy_only=False)
            lists = batch.column("prefix").to_pylist()
            owner = np.repeat(np.arange(len(ids)), [len(x) // 8 for x in lists])
            keys, docs, size = np.frombuffer(b"".join(lists), "u8"), ids[owner], sizes[owner]
            # Sets of equal size that share a key in this batch are linked here, and
            # only the smallest document goes on: a frequent key goes out once a size.
            order = np.lexsort((docs, size, keys))
            keys, docs, size = keys[order], docs[order], size[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (size[1:] != size[:-1])
            first = np.flatnonzero(new)
            least = np.repeat(docs[first], run_lengths(first, len(keys))) if len(first) else docs
            bucket = (mix(keys[first]) % np.uint64(count)).astype(np.int32)
            yield _rows(dealt(bucket, {"keys": keys[first], "docs": docs[first], "sizes": size[first]}))
            links = np.unique(np.column_stack((docs[~new], least[~new])), axis=0)
            if len(links):
                bucket = (mix(links[:, 0].astype(np.uint64)) % np.uint64(count)).astype(np.int32)
                yield _rows(dealt(bucket, {"a": links[:, 0], "b": links[:, 1]}))

    def match(table: pa.Table) -> pa.Table:
        a, b = _chained(*(unpacked(table, c, t) for c, t in (("keys", "u8"), ("docs", "i8"), ("sizes", "i8"))), percent)
        links = np.column_stack((np.concatenate((a, unpacked(table, "a", "i8"))), np.concatenate((b, unpacked(table, "b", "i8")))))
        links = np.unique(links, axis=0)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return sets.mapInArrow(lean(scan), PREFIX_ROWS).groupBy("bucket").applyInArrow(lean(match), "a long, b long")


_NAMES = ("bucket", "keys", "docs", "sizes", "a", "b")


def _rows(packed: pa.RecordBatch) -> pa.RecordBatch:
    nothing = pa.array([b""] * packed.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([packed.column(n) if n in packed.schema.names else nothing for n in _NAMES], names=list(_NAMES))


class Index:
    """Inverted lists over sets, each of distinct hashes; a set is known by its place.

    ``sizes`` are those of the whole sets, of which grams that no other set has may be left out.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None):
        held = np.array([len(s) for s in sets], np.int64)
        self.sizes = held if sizes is None else sizes
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, self.owners = every[order], np.repeat(np.arange(len(sets)), held)[order]
        del order
        first = runs(every)
        self.grams, self.begins = every[first], np.append(first, len(every))

    def lists(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and lengths of the inverted lists of the grams that the index has."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        at = at[self.grams[at] == found]
        return self.begins[at], self.begins[at + 1] - self.begins[at]

    def occurring(self, found: np.ndarray, least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets among ``wanted`` (a mask) that occur in ``least`` lists of ``found``, and how often."""
        begins, lengths = self.lists(found)
        if len(lengths) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        # The longer a list, the more a binary search in it saves against merging it.
        aside = min(least - 1, int(least / (0.01 * math.log(max(lengths[-1], 2)) + 1)))
        short = len(lengths) - aside
        sets, counts = self._merged(begins[:short], lengths[:short])
        keep = (counts >= least - aside) & wanted[sets]
        sets, counts = sets[keep], counts[keep]
        for i in range(short, len(lengths)):
            if not len(sets):
                break
            of_list = self.owners[begins[i] : begins[i] + lengths[i]]
            at = np.minimum(np.searchsorted(of_list, sets), len(of_list) - 1)
            counts = counts + (of_list[at] == sets)
            keep = counts >= least - (len(lengths) - 1 - i)
            sets, counts = sets[keep], counts[keep]
        return sets, counts

    def _merged(self, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets in the short lists, and in how many."""
        if lengths.sum() <= HEAP_ENTRIES:
            lists = [self.owners[a : a + n].tolist() for a, n in zip(begins.tolist(), lengths.tolist()) if n]
            merged = np.fromiter(heapq.merge(*lists), np.int64)
            first = runs(merged) if len(merged) else np.zeros(0, np.int64)
            return merged[first], run_lengths(first, len(merged))
        counts = np.zeros(len(self.sizes), np.int64)
        for a, n in zip(begins.tolist(), lengths.tolist()):
            counts[self.owners[a : a + n]] += 1  # a set is in a list once
        sets = np.flatnonzero(counts)
        return sets, counts[sets]


def similar_links(
    ids: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, indexed: np.ndarray, percent: int, known: np.ndarray
) -> Iterator[tuple[int, int]]:
    """Links of the search of each set in the index of those ``indexed`` (a mask).

    ``sizes`` are those of the whole sets, of which grams that no other set has may be left out.
    ``known`` tells classes that are linked before. Not every pair: sets that are linked already, over any way, are not searched again,
    so a group of n copies gives n - 1 links. Sets of one component of the result are
    exactly those that similar pairs connect.
    """
    places = np.flatnonzero(indexed)
    if not len(places):
        return
    index = Index([sets[i] for i in places], sizes[places])
    root = np.unique(known, return_inverse=True)[1]
    # Everything that looks like the first unlinked one is linked to it, until the rest is
    # searched; a set that has found its group looks only for sets outside of it.
    for i in np.argsort(ids, kind="stable").tolist():
        n = int(sizes[i])
        wanted = (root[places] != root[i]) & (100 * index.sizes >= percent * n) & (100 * n >= percent * index.sizes)
        if not wanted.any():
            continue
        found, shared = index.occurring(sets[i], _least_overlap(n, percent), wanted)
        found = found[_similar(shared, n, index.sizes[found], percent)]
        for other in places[found].tolist():
            if root[other] != root[i]:
                yield i, other
                root[root == root[other]] = root[i]


def _bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)).cast("int")


def with_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` joined with ``members``, most others being left out before the shuffle.

    By a filter of fixed size (4 MB): a bit for each hash of a member's id. The more
    members, the more others pass; the join decides.
    """

    def pack(table: pa.Table) -> pa.Table:
        bits = table.column("bit").to_numpy()
        chunk = np.zeros(CHUNK_BITS, bool)
        chunk[bits % CHUNK_BITS] = True
        return pa.table({"chunk": pa.array([int(bits[0]) // CHUNK_BITS], pa.int32()), "bits": [np.packbits(chunk).tobytes()]})

    bits = members.select(_bit("doc_id").alias("bit")).distinct()
    packed = bits.groupBy(F.shiftright("bit", CHUNK_BITS.bit_length() - 1)).applyInArrow(pack, "chunk int, bits binary")
    every = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in packed.collect():
        every[row["chunk"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(every)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                bit = batch.column("bit").to_numpy()
                known = shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1
                batch = batch.filter(pa.array(known.astype(bool)))
                if batch.num_rows:
                    yield batch.select(["doc_id", "text"])

    return docs.select("doc_id", "text", _bit("doc_id").alias("bit")).mapInArrow(lean(keep), "doc_id long, text string").join(members, "doc_id")


def gram_rows(rows: DataFrame, grams: int) -> DataFrame:
    """``rows`` with n_shingles and grams, the hashes of a set, in place of the text."""
    names = [c for c in rows.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, body, held = 0, [], 0
            for row, found in gram_sets(batch.column("text"), grams):
                body.append(found.tobytes())
                held += len(found)
                if held >= HELD_GRAMS or row + 1 == batch.num_rows:
                    part = batch.slice(begin, len(body))
                    sizes = pa.array([len(x) // 8 for x in body], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sizes, pa.array(body, pa.binary())], names=[*names, "n_shingles", "grams"])
                    begin, body, held = row + 1, [], 0

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c != "text")
    return rows.mapInArrow(lean(cut), f"{kinds}, n_shingles long, grams binary")


def shared_grams(rows: DataFrame, percent: int, count: int) -> DataFrame:
    """``(doc_id, n_shingles, grams)`` of sets that can be similar to another of their component.

    ``rows`` has component, too. Grams are hashed anew with the component, and those that
    no other set of it has are left out; n_shingles stays the size of the whole set. A
    gram goes to its count once for each ``HELD_GRAMS`` grams, however many sets have it.
    """

    def deal(to: np.ndarray, told: bool, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        packed = dealt((mix(to) % np.uint64(count)).astype(np.int32), columns)
        return pa.RecordBatch.from_arrays([packed.column(0), pa.array([told] * packed.num_rows), *packed.columns[1:]], names=["bucket", "told", *columns])

    def send(held: list[tuple[np.ndarray, int, int, int]]) -> Iterator[pa.RecordBatch]:
        lengths = [len(keys) for keys, *_ in held]
        keys = np.concatenate([keys for keys, *_ in held])
        columns = {"keys": keys}
        for name, k, kind in (("sets", 1, np.uint64), ("docs", 2, np.int64), ("sizes", 3, np.int64)):
            columns[name] = np.repeat(np.array([x[k] for x in held], kind), lengths)
        order = np.argsort(keys, kind="stable")
        first = runs(keys[order])
        often = np.zeros(len(keys), np.uint8)
        often[order[first]] = run_lengths(first, len(keys)) > 1
        columns["often"] = often
        once = np.zeros(len(keys), bool)
        once[order[first]] = True
        for told, some in ((False, once), (True, ~once)):
            if some.any():
                yield deal(columns["sets" if told else "keys"][some], told, {name: values[some] for name, values in columns.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("doc_id").to_numpy(), batch.column("n_shingles").to_numpy()
            components = mix(batch.column("component").to_numpy().astype(np.uint64))
            data, offsets = flat(batch.column("grams"))
            held, size = [], 0
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                found = data[a:b].view(np.uint64)
                if len(found):
                    name = mix(found).sum(dtype=np.uint64) ^ mix(ids[i : i + 1].astype(np.uint64))[0]
                    held.append((mix(found ^ components[i]), name, ids[i], sizes[i]))
                    size += len(found)
                if held and (size >= HELD_GRAMS or i + 1 == batch.num_rows):
                    yield from send(held)
                    held, size = [], 0

    kinds = (("keys", "u8"), ("sets", "u8"), ("docs", "i8"), ("sizes", "i8"))

    def match(table: pa.Table) -> pa.Table:
        told = table.filter(table.column("told"))
        asked = table.filter(pc.invert(table.column("told")))
        keys = unpacked(asked, "keys", "u8")
        _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        times += np.bincount(place[unpacked(asked, "often", "u1").astype(bool)], minlength=len(times))
        keep = times[place] > 1
        columns = {name: np.concatenate((unpacked(asked, name, kind)[keep], unpacked(told, name, kind))) for name, kind in kinds}
        return pa.Table.from_batches([dealt((mix(columns["sets"]) % np.uint64(count)).astype(np.int32), columns)])

    def gather(table: pa.Table) -> pa.Table:
        keys, sets, docs, sizes = (unpacked(table, name, kind) for name, kind in kinds)
        order = np.lexsort((keys, sets))
        new = np.ones(len(order), bool)  # rows that are equal sent the same
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (sets[order[1:]] != sets[order[:-1]])
        order = order[new]
        first = runs(sets[order])
        last = np.append(first[1:], len(order))
        ids, n, keys = docs[order[first]], sizes[order[first]], keys[order]
        keep = np.flatnonzero((last - first) * 100 >= n * percent)
        body = [keys[first[i] : last[i]].tobytes() for i in keep.tolist()]
        return pa.table({"doc_id": ids[keep], "n_shingles": n[keep], "grams": pa.array(body, pa.binary())})

    packed = rows.select("doc_id", "component", "n_shingles", "grams").mapInArrow(lean(scan), GRAM_ROWS)
    told = packed.groupBy("bucket").applyInArrow(lean(match), "bucket int, keys binary, sets binary, docs binary, sizes binary")
    return told.groupBy("bucket").applyInArrow(lean(gather), "doc_id long, n_shingles long, grams binary")


def search(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, count: int) -> DataFrame:
    """Links ``(a, b)`` of similar sets, of those that meet in a tile.

    ``members`` has doc_id, component, class (linked before), tiles, and own, the block of
    tiles in which a set is indexed (-1: in none); in others it is searched. ``sets_of`` gives
    them their n_shingles and grams.
    """

    def match(table: pa.Table) -> pa.Table:
        ids, component, sizes = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
        known, indexed = table.column("class").to_numpy(), table.column("own").to_numpy() == table.column("tile").to_numpy() // SLICES
        sets = []
        for chunk in table.column("grams").chunks:
            data, offsets = flat(chunk)
            sets += [data[a:b].view(np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        links = []
        order = np.argsort(component, kind="stable")
        for group in np.split(order, runs(component[order])[1:]):
            found = similar_links(ids[group], [sets[i] for i in group.tolist()], sizes[group], indexed[group], percent, known[group])
            links += [(ids[group[a]], ids[group[b]]) for a, b in found]
        links = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    rows = sets_of(members).select("doc_id", "component", "class", "own", "n_shingles", "grams", F.explode("tiles").alias("tile"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("component", "tile"), F.lit(count)))
    return rows.groupBy("bucket", "tile").applyInArrow(lean(match), "a long, b long")


def _dealt(name: str, parts: Column, draw: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(draw)), parts)


def _parts(sets: Column, load: Column, index_sets: int) -> Column:
    """Into how many searches so many sets go, whose grams take ``load`` of them."""
    return F.ceil(F.greatest(sets / index_sets, load)).cast("long")


def too_large(sets: DataFrame, index_sets: int) -> DataFrame:
    """Components of ``sets`` that one search can't hold."""
    parts = sets.groupBy("component").agg(_parts(F.count("*"), F.sum("load"), index_sets).alias("parts"))
    return parts.filter("parts > 1").select("component")


def in_pieces(sets: DataFrame, index_sets: int, draw: int) -> DataFrame:
    """Members for :func:`search` from (doc_id, component, class, load): each set in one piece."""
    sizes = sets.groupBy("component").agg(_parts(F.count("*"), F.sum("load"), index_sets).alias("pieces"))
    dealt_out = sets.join(sizes, "component").withColumn("own", _dealt("doc_id", F.col("pieces"), draw))
    return dealt_out.select("doc_id", "component", "class", "load", "own", F.array(F.col("own") * SLICES + F.col("own")).alias("tiles"))


def in_tiles(sets: DataFrame, index_sets: int) -> DataFrame:
    """Members for :func:`search` from (doc_id, component, class): all sets of different classes meet.

    The sets of all classes but the largest are dealt over blocks, which are indexed, and
    all sets over slices, which are searched in each block. Without a load, sets count alone.
    """
    if "load" not in sets.columns:
        sets = sets.withColumn("load", F.lit(0.0))
    classes = sets.groupBy("component", "class").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    largest = F.max(F.struct("n", "class", "load"))
    sizes = classes.groupBy("component").agg(
        largest["class"].alias("largest"),
        _parts(F.sum("n") - F.max("n"), F.sum("load") - largest["load"], index_sets).alias("blocks"),
        _parts(F.sum("n"), F.sum("load"), index_sets).alias("slices"),
        (F.count("*") > 1).alias("several"),
    )
    block, slice_ = _dealt("doc_id", F.col("blocks"), 2), _dealt("doc_id", F.col("slices"), 3)
    searched = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x * SLICES + F.col("slice"))
    indexed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda x: F.col("own") * SLICES + x)
    return (
        sets.join(sizes.filter("several").withColumn("blocks", F.greatest("blocks", F.lit(1).cast("long"))), "component")
        .withColumn("own", F.when(F.col("class") == F.col("largest"), F.lit(-1).cast("long")).otherwise(block))
        .withColumn("slice", slice_)
        .withColumn("tiles", F.when(F.col("own") < 0, searched).otherwise(F.array_union(searched, indexed)))
        .select("doc_id", "component", "class", "load", "own", "tiles")
    )


def unsettled(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``(doc_id, component, class)`` of sets that share a filed gram with one of another class.

    ``sets`` has doc_id and prefix, ``classes`` node and class.
    """
    places = F.sequence(F.lit(0), (F.octet_length("prefix") / 8).cast("int") - 1)
    filed = sets.join(classes.withColumnRenamed("node", "doc_id"), "doc_id").select(
        "doc_id", "class", F.explode(F.transform(places, lambda i: F.substring(F.col("prefix"), i * 8 + 1, F.lit(8)))).alias("key")
    )
    mixed = filed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("doc_id").alias("least"))
    meeting = written(filed.join(mixed.filter("low < high").select("key", "least"), "key").select("doc_id", "class", "least").distinct(), "meeting")
    found = components(meeting.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    return meeting.select("doc_id", "class").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id")


def linked(near: DataFrame, sets: DataFrame, docs: DataFrame, grams: int, percent: int, index_sets: int) -> DataFrame:
    """Links ``(a, b)`` that connect just the sets that similar pairs connect; ``near`` has node and component."""

    def searched(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rows = members.agg(F.sum(F.size("tiles")), F.sum(F.size("tiles") * F.col("load"))).first()
        count = max(buckets(docs), -(-(rows[0] or 0) // index_sets), math.ceil(rows[1] or 0))
        return written(search(members, sets_of, percent, count), "links")

    def loaded(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
        loads = sizes.groupBy("doc_id").agg((F.sum("n") / INDEX_GRAMS).alias("load"))
        return written(nodes.join(loads, "doc_id").select("doc_id", "component", F.col("doc_id").alias("class"), "load"), "nodes")

    def cut(members: DataFrame) -> DataFrame:
        return gram_rows(with_members(docs, members), grams)

    nodes = loaded(near.withColumnRenamed("node", "doc_id"), sets.select("doc_id", F.col("n_shingles").alias("n")))
    large = too_large(nodes, index_sets)
    links = searched(in_pieces(nodes.join(large, "component", "left_anti"), index_sets, 0), cut)
    if large.isEmpty():
        return links
    nodes = nodes.join(large, "component", "left_semi").select("doc_id", "component")
    left = written(shared_grams(cut(nodes), percent, buckets(docs)), "shared")
    nodes = loaded(nodes, left.select("doc_id", (F.octet_length("grams") / 8).alias("n")))

    def kept(members: DataFrame) -> DataFrame:
        return left.join(members, "doc_id")

    pieces = searched(in_pieces(nodes, index_sets, 0), kept)
    large = too_large(nodes, index_sets)
    if large.isEmpty():
        return links.union(pieces)
    nodes = written(nodes.join(large, "component", "left_semi").drop("class"), "large")

    def classes() -> DataFrame:
        joined = components(pieces).select(F.col("node").alias("doc_id"), F.col("component").alias("class"))
        return nodes.join(joined, "doc_id", "left").select("doc_id", "component", F.coalesce("class", "doc_id").alias("class"), "load")

    pieces = pieces.union(searched(in_pieces(classes().filter("doc_id = class"), index_sets, 1), kept))
    rest = unsettled(sets, classes().select(F.col("doc_id").alias("node"), "class"))
    rest = written(rest.join(nodes.select("doc_id", "load"), "doc_id"), "unsettled")
    return links.union(pieces).union(searched(written(in_tiles(rest, index_sets), "tiles"), kept))


def similar_documents(
    df: DataFrame, grams: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", index_sets: int = INDEX_SETS
) -> DataFrame:
    """``doc_id`` with n_shingles and component_id, one row for each row of ``df``.

    Two documents link if their sets of ``grams`` lower-cased words have a Jaccard
    similarity of ``percent`` in a hundred or more; component_id is the smallest doc_id
    that links reach. Null and empty texts have an empty set and link with nothing.
    A null doc_id takes no part and is its own (null) component. Rows that share a doc_id
    are one document, linked by any of its texts. Other columns are ignored; an empty
    table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(docs, grams, percent, common_grams(docs, grams, percent, COMMON_GRAMS)), "sets")
    known = prints.filter("doc_id is not null and fingerprint is not null")
    classes = known.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    # One row for each distinct set; of rows that share an id, every set counts.
    sets = known.join(classes, ["fingerprint", "doc_id"], "left_semi").select("doc_id", "n_shingles", "prefix")
    near = components(candidate_links(sets, percent))
    links = linked(near, sets, docs.filter("doc_id is not null"), grams, percent, index_sets)
    # Classes of an id with several texts are joined over that id.
    equal = known.join(classes.withColumnRenamed("doc_id", "b"), "fingerprint").select(F.col("doc_id").alias("a"), "b").distinct()
    split = equal.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    joined = components(links.union(equal.join(split, "a", "left_semi")))
    classes = classes.withColumnRenamed("doc_id", "node").join(joined, "node", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id")
    )
    least = F.least(F.coalesce("component_id", "doc_id"), "doc_id")
    return (
        prints.select("doc_id", "n_shingles", "fingerprint")
        .join(classes, "fingerprint", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), least).alias("component_id"))
    )
