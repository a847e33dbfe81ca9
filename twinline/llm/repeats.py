"""What the two exact removals of long repeats share.

Both find repeats in three steps. Each document gives *keys*, hashes that are a function
of its content alone and so dense that any repeat holds the same key in all its places.
Keys are counted, and those seen once are dropped; what is left marks the few places
that can be repeats. Those are cut out and compared in full, key by key.

Rows that share a doc_id count as one document. If their texts differ, each loses what
is found in any of them, as far as it reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.flat import buckets, chunks, dealt, mix, run_lengths, runs, unpacked

KEY_ROWS = "bucket int, keys binary, docs binary, states binary"

# States of a key in a document, as its batch of documents knows it.
ONCE, FIRST_OF_SEVERAL, LATER_OF_SEVERAL = 0, 1, 2


def documents(df: DataFrame, doc_id: str, text: str, made: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``text`` under these names, and the other columns but for those ``made`` anew."""
    clash = {doc_id, text, "doc_id", "text", "keys", "_strings", "runs", *made}
    others = [c for c in df.columns if c not in clash]
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *others)


def _once_per_row(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), and whether the row holds it again."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    return rows[first], keys[first], run_lengths(first, len(keys)) > 1


def repeated_keys(docs: DataFrame, keys_of: Callable, across: bool) -> DataFrame:
    """``(doc_id, keys)``: the keys of each document that are found elsewhere too.

    ``keys_of(data, offsets)`` gives the row and the key of everything in a chunk of
    texts. ``across``: only another document counts as elsewhere.

    A key that several documents of a batch hold is sent to its bucket for the first of
    them only; for the others it is known already. So a key that fills the table reaches
    its bucket once a batch.
    """
    count = buckets(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
            for row, data, offsets in chunks(batch.column("text")):
                rows, keys, again = _once_per_row(*keys_of(data, offsets))
                found.append((rows + row, keys, again))
            rows, keys, again = (np.concatenate(x) for x in zip(*found))
            if not len(keys):
                continue
            owner = ids[rows]
            order = np.lexsort((owner, keys))
            owner, keys, again = owner[order], keys[order], again[order]
            first = runs(keys)
            size = run_lengths(first, len(keys))
            if across:
                several = owner[first] != owner[first + size - 1]
            else:
                several = (size > 1) | np.logical_or.reduceat(again, first)
            state = np.full(len(keys), LATER_OF_SEVERAL, np.uint8)
            state[first] = np.where(several, FIRST_OF_SEVERAL, ONCE)
            told = np.flatnonzero((state != LATER_OF_SEVERAL) | np.repeat(several, size))
            owner, keys, state = owner[told], keys[told], state[told]
            by_key = (mix(keys) % np.uint64(count)).astype(np.int32)
            by_doc = (mix(owner.astype(np.uint64)) % np.uint64(count)).astype(np.int32)
            bucket = np.where(state == LATER_OF_SEVERAL, by_doc, by_key)
            yield dealt(bucket, {"keys": keys, "docs": owner, "states": state})

    def match(table: pa.Table) -> pa.Table:
        keys, docs, states = unpacked(table, "keys", "u8"), unpacked(table, "docs", "i8"), unpacked(table, "states", "u1")
        waiting = np.flatnonzero(states != LATER_OF_SEVERAL)
        order = waiting[np.lexsort((docs[waiting], keys[waiting]))]
        found = [np.flatnonzero(states == LATER_OF_SEVERAL)]
        if len(order):
            first = runs(keys[order])
            size = run_lengths(first, len(order))
            several = docs[order[first]] != docs[order[first + size - 1]] if across else size > 1
            several |= np.logical_or.reduceat(states[order] == FIRST_OF_SEVERAL, first)
            found.append(order[np.repeat(several, size)])
        found = np.concatenate(found)
        return pa.table({"doc_id": docs[found], "key": keys[found].view(np.int64)})

    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(scan, KEY_ROWS)
    pairs = rows.groupBy("bucket").applyInArrow(match, "doc_id long, key long")
    return pairs.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def with_repeated_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Every row with its repeated keys, or null.

    A left join of all rows, as in :func:`with_runs`, so that Spark shuffles the
    documents once for both.
    """
    return docs.join(keys, "doc_id", "left")


def marked(batch: pa.RecordBatch, row: int, stop: int, column: str = "keys") -> np.ndarray:
    """The repeated keys of rows ``row`` to ``stop``, each joined with its row, sorted."""
    lists = batch.column(column).slice(row, stop - row)
    keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return np.sort(joined(owner, keys))


def joined(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a row and a key. A clash only adds a place to compare."""
    return mix(keys ^ mix(rows.astype(np.uint64)))


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def with_runs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``runs``, its ``(start, stop)`` pairs flat in one array, or null."""
    lists = found.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias("runs"))
    return docs.join(lists, "doc_id", "left")


def covered(length: int, pairs: np.ndarray, reach: int) -> np.ndarray:
    """Which of ``length`` places lie in a window of ``reach`` that starts in ``[start, stop)``."""
    steps = np.zeros(length + 1, np.int64)
    starts, stops = np.minimum(pairs[::2], length), np.minimum(pairs[1::2] - 1 + reach, length)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:-1]) > 0
