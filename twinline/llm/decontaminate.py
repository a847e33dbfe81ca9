"""Benchmark decontamination: approximate copies of benchmark items inside documents.

An item of m characters that a document holds within k edits shares at least
m + 1 - (k + 1) q of its q-grams with it, on diagonals (place in the document less place
in the item) that are no more than k apart: the q-gram lemma. Documents are scanned for
the items' q-grams, hits are counted in overlapping bands of 2k + 1 diagonals, and bands
that reach the bound are verified by alignment along the band.

The items are the stated query set. They go to all tasks in blocks of bounded size, one
scan of the documents for each block, so no bound is put on their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.flat import BYTE_DRAW, SPACE, UPPER_TO_LOWER, chunks, lean, mix, run_lengths, runs
from twinline.session import ship

GRAM = 8
# Characters of items that are broadcast at once, and bits of the filter over their grams.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat texts in lower case, with runs of white space as one space, trimmed.

    A-Z and the capitals of Latin-1 are lower-cased, which keeps every byte's place.

    Returns the bytes, where each text begins, and each byte's place before.
    """
    # In UTF-8 the capitals are C3 80 to C3 9E; C3 97 is the multiplication sign.
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(SPACE[data], np.uint8(32), UPPER_TO_LOWER[data]) + capital * np.uint8(32)
    space = data == 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~edge[1:-1]
    place = np.flatnonzero(keep)
    # A space that ends a text goes too.
    row = np.searchsorted(offsets, place, "right") - 1
    last = np.ones(len(place), bool)
    last[:-1] = row[1:] != row[:-1]
    place = place[~(last & space[place])]
    return data[place], np.searchsorted(place, offsets), place


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h = np.zeros(max(0, len(data) - gram + 1), np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + BYTE_DRAW[data[i : i + len(h)]]
    return mix(h)


def edit_budget(length: int, rate: float, gram: int) -> int:
    """Edits allowed in an item: ``rate`` of its length, and no more than the lemma can tell."""
    return max(0, min(int(length * rate), length // gram - 1))


class Items:
    """The q-grams of a block of items: hash, item and place, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str], rate: float, gram: int):
        whole = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        flat = [canonical(b, np.array([0, len(b)]))[0] for b in whole]
        kept = [i for i, b in enumerate(flat) if len(b)]
        self.ids = np.array([ids[i] for i in kept], np.int64)
        self.texts = [flat[i] for i in kept]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.gram = gram
        self.budgets = np.array([edit_budget(n, rate, gram) for n in self.sizes], np.int64)
        self.bounds = np.maximum(1, self.sizes + 1 - (self.budgets + 1) * gram)
        # An item shorter than a gram is padded by nothing: it is found by its whole hash.
        hashes, item, place = [], [], []
        for i, text in enumerate(self.texts):
            h = gram_hashes(text, gram)
            hashes.append(h), item.append(np.full(len(h), i)), place.append(np.arange(len(h)))
        self.hashes, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.item, self.place = self.hashes[order], self.item[order], self.place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.short = [i for i in range(len(kept)) if self.sizes[i] < gram]
        self.verified: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, item, place in the item) of equal grams."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        a, b = np.searchsorted(self.hashes, hashes[at]), np.searchsorted(self.hashes, hashes[at], "right")
        size = b - a
        at, a, size = at[size > 0], a[size > 0], size[size > 0]
        one = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(at, size), self.item[one], self.place[one]

    def bands(self, row: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first and last diagonal) of the regions that reach the item's bound.

        Bands start at every multiple of k + 1 and are 2 k + 2 wide, so any 2k + 1
        neighbouring diagonals, hence all of an alignment around its first hit, lie in
        one or the next. A gram of the item counts once in a band.
        """
        budget = self.budgets[item]
        diagonal = at - place
        step = np.floor_divide(diagonal, budget + 1)
        rows, items, steps, grams = (np.concatenate((x, x)) for x in (row, item, step, place))
        steps[len(row) :] -= 1
        order = np.lexsort((grams, steps, items, rows))
        rows, items, steps, grams = rows[order], items[order], steps[order], grams[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]) | (steps[1:] != steps[:-1])
        once = new.copy()
        once[1:] |= grams[1:] != grams[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return
        count = np.add.reduceat(once.astype(np.int64), first)
        for i in first[count >= self.bounds[items[first]]].tolist():
            k = int(self.budgets[items[i]])
            yield int(rows[i]), int(items[i]), int(steps[i]) * (k + 1), int(steps[i] + 2) * (k + 1) - 1

    def align(self, item: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the item's best alignment with a part of ``text``.

        Only cells on the diagonals ``low - k`` to ``high + k`` are filled, as an alignment
        leaves the band of its hits by no more than its edits. None beyond the budget.
        """
        k, pattern = int(self.budgets[item]), self.texts[item]
        low, high = low - k, high + k
        m, width = len(pattern), high - low + 1
        begin = max(0, low)
        region = text[begin : max(begin, min(len(text), m + high))]
        key = (item, region.tobytes() + b"\\0" + str((low - begin, width)).encode())
        if key not in self.verified:
            if len(self.verified) > 100_000:
                self.verified.clear()
            self.verified[key] = _banded(pattern, region, low - begin, width, k)
        best = self.verified[key]
        return best and (best[0], best[1] + begin, best[2] + begin)


def _banded(pattern: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Edit distance of the whole pattern to any part of the text, on diagonals low to low + width - 1.

    Cell c of row i is the text's place i + low + c; its cost and where its alignment
    began are carried together, so that the start is known without going back. An alignment
    without edits is one diagonal of equal bytes; the first one in the band is the best.
    """
    same = text.tobytes().find(pattern.tobytes())
    if low <= same <= low + width - 1 and same >= 0:
        return 0, same, same + len(pattern)
    far = 1 << 20
    n, cell = len(text), np.arange(width)
    # Row i has the places from i on, of all that the band passes: letters, and what lies outside of the text.
    places = low + np.arange(len(pattern) + width)
    letters = np.full(len(places), -1, np.int64)
    has = (places >= 1) & (places <= n)
    letters[has] = text[places[has] - 1]
    outside = np.where((places >= 0) & (places <= n), 0, far)
    no_letter = np.where(has, 0, far)
    cost, start = outside[:width].copy(), places[:width].copy()
    above, from_above = np.full(width, far), np.zeros(width, np.int64)
    for i in range(1, len(pattern) + 1):
        across = cost + (letters[i : i + width] != pattern[i - 1]) + no_letter[i : i + width]
        above[:-1], from_above[:-1] = cost[1:] + 1, start[1:]
        new = np.minimum(above, across) + outside[i : i + width]
        begun = np.where(above < across, from_above, start)
        # Letters of the text that the pattern lacks: the least of cost - cell so far.
        slant = new - cell
        source = np.maximum.accumulate(np.where(slant == np.minimum.accumulate(slant), cell, 0))
        cost = np.where(outside[i : i + width], far, slant[source] + cell)
        start = begun[source]
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), int(len(pattern) + low + end)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    rate: float = 0.1,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, n_edits, start, stop``: items found in documents, one row a pair.

    A document holds an item if a part of it is within ``rate`` edits a character of the
    whole item, both in lower case (A-Z and Latin-1) and with white space as one space. Of several places
    the one with fewest edits, then the first, is told, in bytes of the document's text.
    Items shorter than a gram must be found as they are. Null and empty texts hold
    nothing, and items without text are in nothing; null ids are told like others; a
    repeated row is told once; other columns are ignored; empty tables give an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("length(text) > 0")
    out = "doc_id long, item_id long, n_edits int, start long, stop long"
    found = None
    block: list[tuple[int, str]] = []
    held = 0

    def scanned(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items([i for i, _ in block], [t for _, t in block], rate, gram))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _scan_once(batches, shared.value)

        return rows.mapInArrow(lean(scan), out)

    for item in asked.distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((item["item_id"], item["text"]))
        held += len(item["text"])
        if held >= block_chars:
            found = scanned(block) if found is None else found.union(scanned(block))
            block, held = [], 0
    if block:
        found = scanned(block) if found is None else found.union(scanned(block))
    if found is None:
        return spark.createDataFrame([], out)
    best = F.min(F.struct("n_edits", "start", "stop")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _scan_once(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """A task's scan. The items stay in the worker after it; what they remember of its texts doesn't."""
    try:
        yield from _scan(batches, items)
    finally:
        items.verified.clear()


def _scan(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        told: list[tuple] = []
        for first, raw, raw_offsets in chunks(batch.column("text")):
            data, offsets, place = canonical(raw, raw_offsets)
            if not len(data):
                continue
            at, item, inner = items.hits(gram_hashes(data, items.gram))
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + items.gram <= offsets[row + 1]
            at, item, inner, row = at[inside], item[inside], inner[inside], row[inside]
            # Items with too few hits in a text are out before their diagonals are sorted.
            pair = row * len(items.ids) + item
            order = np.argsort(pair, kind="stable")
            head = runs(pair[order])
            size = run_lengths(head, len(order))
            order = order[np.repeat(size >= items.bounds[item[order[head]]], size)]
            at, item, inner, row = at[order], item[order], inner[order], row[order]
            spots = []
            for r, i, low, high in items.bands(row, item, at - offsets[row], inner):
                best = items.align(i, data[offsets[r] : offsets[r + 1]], low, high)
                if best:
                    spots.append((r, i, *best))
            if items.short:
                whole = data.tobytes()
                for r in range(len(offsets) - 1):
                    for i in items.short:
                        spot = whole.find(items.texts[i].tobytes(), offsets[r], offsets[r + 1])
                        if spot >= 0:
                            spots.append((r, i, 0, spot - int(offsets[r]), spot - int(offsets[r]) + int(items.sizes[i])))
            for r, i, edits, start, stop in spots:
                begin, end = place[offsets[r] + start], place[max(offsets[r] + stop - 1, offsets[r] + start)] + 1
                told.append((ids[first + r], int(items.ids[i]), edits, int(begin - raw_offsets[r]), int(end - raw_offsets[r])))
        if told:
            columns = list(zip(*dict.fromkeys(told)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "n_edits", "start", "stop"]
            )
