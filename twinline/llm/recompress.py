"""Removal of long word repeats between documents, by recompression.

Rounds of naming shrink each document: first runs, two equal tokens at a time, then
pairs, where a token whose draw is lower than both its neighbours' joins the one behind
it. A name is a hash of the two names it joins, so equal pairs get equal names in every
document and no round has to gather a dictionary. Whether a token joins depends on its
neighbours only; each symbol keeps the span of words that decided it. Equal strings of
``window`` words hence hold the same symbols wherever the deciding span lies inside.

Spark counts the symbols of the last round across documents. A window can be a repeat
only if all symbols decided inside it are found in other documents; those windows are
verified by digests of their words, dealt by their first such symbol, and windows that
hold none by their own digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm import repeats
from twinline.llm.flat import buckets, chunks, dealt, flat, mix, powers, run_lengths, unpacked, words
from twinline.session import ship

PAIR_ROUNDS = 4

WINDOW_ROWS = "bucket int, digests binary, checks binary, docs binary, starts binary, known binary"


def symbols(names: np.ndarray, rows: np.ndarray, rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and deciding span of words (first, behind last) of the last round's symbols.

    ``names`` and ``rows`` are the words' hashes and documents, in order. A symbol that
    the edge of its document helped to decide has a span that reaches one word beyond
    it. Both ends of the spans are in order.
    """
    n = len(names)
    low, high, row = np.arange(n), np.arange(1, n + 1), rows
    begin = np.searchsorted(rows, rows)  # the document's first word, and the one behind its last
    end = np.searchsorted(rows, rows, "right")
    for turn in range(rounds + 1):
        n = len(names)
        if n == 0:
            break
        draw = mix(names + np.uint64(turn + 1)) | np.uint64(1)
        # Neighbours' draws and spans; none at the edge of a document.
        same = np.zeros(n + 1, bool)
        same[1:-1] = row[1:] == row[:-1]
        left_low = np.where(same[:-1], np.concatenate((low[:1], low[:-1])), begin - 1)
        right_high = np.where(same[1:], np.concatenate((high[1:], high[-1:])), end + 1)
        if turn == 0:
            alike = np.zeros(n + 1, bool)
            alike[1:-1] = same[1:-1] & (names[1:] == names[:-1])
            run = np.flatnonzero(~alike[:-1])
            size = run_lengths(run, n)
            within = np.arange(n) - np.repeat(run, size)
            joins = (within % 2 == 0) & (within + 1 < np.repeat(size, size))
            # What decides is the run up to here, and that it ends or goes on.
            decided_low, decided_high = np.repeat(left_low[run], size), right_high
            partner_high = np.concatenate((right_high[1:], right_high[-1:]))
        else:
            before = np.where(same[:-1], np.concatenate((draw[:1], draw[:-1])), np.uint64(0))
            behind = np.where(same[1:], np.concatenate((draw[1:], draw[-1:])), np.uint64(0))
            joins = (draw < before) & (draw < behind)
            # One that stays also knows that the one before it does not join it.
            second = np.where(same[:-1], np.concatenate((left_low[:1], left_low[:-1])), left_low)
            decided_low = np.where(joins, left_low, second)
            decided_high = right_high
            partner_high = decided_high
        gone = np.zeros(n, bool)
        gone[1:] = joins[:-1]
        stays = np.flatnonzero(~gone)
        partner = np.minimum(stays + 1, n - 1)
        paired = mix(names * np.uint64(0xD6E8FEB86659FD93) + mix(names[np.minimum(np.arange(n) + 1, n - 1)])) + np.uint64(turn)
        joined = joins[stays]
        row, begin, end = row[stays], begin[stays], end[stays]
        low = decided_low[stays]
        high = np.where(joined, np.maximum(partner_high[stays], high[partner]), decided_high[stays])
        names = np.where(joined, paired[stays], names[stays])
    return names, low, high


def _window_hashes(names: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(names) + 1)
    both = []
    for values in (names, mix(names ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(values * up[: len(names)], out=total[1:])
        both.append(mix((total[starts + window] - total[starts]) * down[starts]))
    return both[0], (both[1] >> np.uint64(32)).astype(np.uint32)


def repeated_windows(docs: DataFrame, window: int, rounds: int = PAIR_ROUNDS) -> DataFrame:
    """``(doc_id, start, stop)``: runs of words where a window starts that also starts in
    a document of smaller id."""
    count = buckets(docs)

    def keys_of(data, offsets):
        names, rows, _, _ = words(data, offsets)
        symbol, low, high = symbols(names, rows, rounds)
        # The last word of a span lies in its document, unless the edge decided; no
        # window holds such a symbol.
        last = np.minimum(high, len(rows)) - 1
        inside = (high - low <= window) & (high <= len(rows)) & (low >= 0)
        inside &= rows[np.maximum(low, 0)] == rows[last]
        return rows[last[inside]], symbol[inside]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = []
            for row, data, offsets in chunks(batch.column("text")):
                names, rows, _, _ = words(data, offsets)
                n = len(names)
                if n < window:
                    continue
                first_word = np.searchsorted(rows, np.arange(len(offsets)))
                starts = np.flatnonzero(rows[: n - window + 1] == rows[window - 1 :])
                symbol, low, high = symbols(names, rows, rounds)
                known = repeats.marked(batch, row, row + len(offsets) - 1)
                alone = ~repeats.is_in(repeats.joined(rows[np.minimum(high, n) - 1], symbol), known)
                unknown = np.concatenate(([0], np.cumsum(alone)))
                a, b = np.searchsorted(low, starts), np.searchsorted(high, starts + window, "right")
                b = np.maximum(a, b)
                take = unknown[a] == unknown[b]
                starts, a, b = starts[take], a[take], b[take]
                digest, check = _window_hashes(names, starts, window)
                named = symbol[np.minimum(a, max(len(symbol) - 1, 0))]
                key = np.where(b > a, named, digest)
                owner = rows[starts]
                found.append((key, digest, check, ids[owner + row], starts - first_word[owner]))
            if not found:
                continue
            key, digest, check, docs_, starts = (np.concatenate(x) for x in zip(*found))
            if not len(key):
                continue
            # Of equal windows in the batch only the smallest document's goes on.
            order = np.lexsort((starts, docs_, check, digest))
            new = np.ones(len(order), bool)
            new[1:] = (digest[order][1:] != digest[order][:-1]) | (check[order][1:] != check[order][:-1])
            first = np.flatnonzero(new)
            least = np.repeat(docs_[order][first], run_lengths(first, len(order)))
            later = order[docs_[order] > least]
            go = order[docs_[order] == least]
            bucket = (mix(key[go]) % np.uint64(count)).astype(np.int32)
            # In order of document and start, which packs well.
            by = np.lexsort((starts[go], docs_[go]))
            go, bucket = go[by], bucket[by]
            yield _batch(dealt(bucket, {"digests": digest[go], "checks": check[go], "docs": docs_[go], "starts": starts[go].astype(np.int32)}))
            if len(later):
                whole = np.column_stack(_as_runs(docs_[later], starts[later]))
                bucket = (mix(whole[:, 0].astype(np.uint64)) % np.uint64(count)).astype(np.int32)
                yield _batch(dealt(bucket, {"known": whole}))

    def match(table: pa.Table) -> pa.Table:
        known = unpacked(table, "known", "i8").reshape(-1, 3)
        digest, check = unpacked(table, "digests", "u8"), unpacked(table, "checks", "u4")
        docs_, starts = unpacked(table, "docs", "i8"), unpacked(table, "starts", "i4").astype(np.int64)
        found = [(known[:, 0], known[:, 1], known[:, 2])]
        if len(digest):
            order = np.lexsort((docs_, check, digest))
            new = np.ones(len(order), bool)
            new[1:] = (digest[order][1:] != digest[order][:-1]) | (check[order][1:] != check[order][:-1])
            first = np.flatnonzero(new)
            least = np.repeat(docs_[order][first], run_lengths(first, len(order)))
            later = order[docs_[order] > least]
            found.append(_as_runs(docs_[later], starts[later]))
        doc, start, stop = (np.concatenate(x) for x in zip(*found))
        return pa.table({"doc_id": doc, "start": start, "stop": stop})

    marked = repeats.with_repeated_keys(docs, repeats.repeated_keys(docs, keys_of, across=True))
    return marked.mapInArrow(cut, WINDOW_ROWS).groupBy("bucket").applyInArrow(match, "doc_id long, start long, stop long")


def _as_runs(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a document as one (doc, start, stop)."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(docs)])) - 1 if len(docs) else first
    return docs[first], starts[first], starts[last] + 1


_NAMES = ("bucket", "digests", "checks", "docs", "starts", "known")


def _batch(packed: pa.RecordBatch) -> pa.RecordBatch:
    nothing = pa.array([b""] * packed.num_rows, pa.binary())
    columns = [packed.column(n) if n in packed.schema.names else nothing for n in _NAMES]
    return pa.RecordBatch.from_arrays(columns, names=list(_NAMES))


def remove_repeated_words(
    df: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", rounds: int = PAIR_ROUNDS
) -> DataFrame:
    """``doc_id`` with n_words, n_removed, the removed spans of words (flat) and the kept text.

    A word goes if one of the windows of ``window`` words that cover it also starts in a
    document of smaller id, judged on the input. Kept words are joined by one space. One
    row for each row of ``df``; null and empty texts have no words; texts under ``window``
    words and rows without a doc_id keep theirs. Rows that share a doc_id are one document
    and don't remove each other; other columns are ignored; an empty table gives an empty one.
    """
    ship(df.sparkSession)
    docs = repeats.documents(df.select(doc_id, text), doc_id, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            counts, removed, spans, kept = [], [], [], []
            for i, found in enumerate(batch.column("runs")):
                body = data[offsets[i] : offsets[i + 1]].tobytes()
                parts = body.split()  # bytes split at ASCII white space only
                gone = np.zeros(len(parts), bool)
                if found.is_valid:
                    gone = repeats.covered(len(parts), found.values.to_numpy(zero_copy_only=False), window)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                counts.append(len(parts))
                removed.append(int(gone.sum()))
                spans.append(edges)
                kept.append(b" ".join(p for p, g in zip(parts, gone.tolist()) if not g) if gone.any() else b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    found = repeated_windows(docs, window, rounds)
    return repeats.with_runs(docs, found).mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, spans array<long>, kept string"
    )


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
