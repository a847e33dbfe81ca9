"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers write a text as tokens that cover its bytes. Where a token of each ends at
the same byte, both lists are cut, so each cut closes a group of tokens that say the same.
The ends are keys of two dictionaries, and the keys that both hold are the cuts. Within a
group, tokens whose bytes overlap are linked. How many documents link a pair of ids says
which token of the other vocabulary an id stands for.

Texts are tokenized and cut once; the ids, two or four bytes each, and the sizes of the
groups are written to the shared folder, and links are made from them anew wherever they
are needed, as that is cheap.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinline.llm.bpe import byte_letters
from twinline.llm.flat import run_lengths, runs
from twinline.session import ship, written

# Characters of text that are tokenized at once, and bytes of ids that are aligned at once
# (a longer text is taken alone).
BATCH_CHARS = 1 << 20
# Pairs of ids that a task counts before it sends them on.
COUNTED_PAIRS = 1 << 20
# Pairs of ids that are sent to every task (24 bytes each); more are joined.
BROADCAST_PAIRS = 1 << 21


# Fixed value: the public pattern of byte-level vocabularies, as the quicker library spells it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: how a byte-level file says that it cuts texts by the public pattern and merges
# in the order of its ids, in its settings and those of its model.
USUAL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
USUAL_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}


class Vocabularies(NamedTuple):
    """Bytes of each token of both tokenizers, and their files' contents."""

    a: list[bytes]
    b: list[bytes]
    byte_level: str
    pieces: bytes
    ranks: dict[bytes, int] | None

    def dtype(self) -> str:
        return "<u2" if max(len(self.a), len(self.b)) <= 1 << 16 else "<u4"


def _ranks(text: str, a: list[bytes]) -> dict[bytes, int] | None:
    """Ids by bytes, if merging in the order of ids by the public pattern is what the file says."""
    data = json.loads(text)
    cut, model, added = data["pre_tokenizer"] or {}, data["model"], {t["id"] for t in data["added_tokens"]}
    usual = all(cut.get(k, v) == v for k, v in USUAL.items()) and all(model.get(k, v) == v for k, v in USUAL_MODEL.items())
    if not usual or data["normalizer"] or not cut:
        return None
    merged = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    words = {i for i in model["vocab"].values() if i not in added}
    if merged != sorted(set(merged)) or len(words) != len(merged) + 256:
        return None
    return {a[i]: i for i in words}


def vocabularies(byte_level_path: str, piece_path: str) -> Vocabularies:
    """Of a byte-level tokenizers file (A) and a sentencepiece model (B), read where the job starts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    text = Path(byte_level_path).read_text("utf-8")
    known = Tokenizer.from_str(text)
    letters = {c: b for b, c in enumerate(byte_letters())}
    added = {i: t.content.encode() for i, t in known.get_added_tokens_decoder().items()}
    entries = {i: t for t, i in known.get_vocab().items()}
    a = [added[i] if i in added else bytes(letters[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
    model = Path(piece_path).read_bytes()
    pieces = SentencePieceProcessor(model_proto=model)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    b = [bytes((int(t[1:-1], 16),)) if pieces.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
    return Vocabularies(a, b, text, model, _ranks(text, a))


def byte_level_encoder(known: Vocabularies) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts without special tokens, whose strings are plain text.

    A file of the usual kind is run by a quicker library that gives the same ids.
    """
    if known.ranks:
        from tiktoken import Encoding

        quick = Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=known.ranks, special_tokens={})
        return lambda texts: [quick.encode_ordinary(t) for t in texts]

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(known.byte_level)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    return lambda texts: [c.ids for c in own.encode_batch_fast(texts, add_special_tokens=False)]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``."""
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


IDS = "doc_id long, a binary, b binary, n_groups long, in_a binary, in_b binary"


def _narrow(sizes: np.ndarray) -> bytes:
    return sizes.astype("<u1" if sizes.max(initial=0) < 1 << 8 else "<u4").tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def token_ids(docs: DataFrame, known: Vocabularies) -> DataFrame:
    """Ids of both tokenizers, packed, and how many of each every group has.

    None where a tokenizer doesn't give back the text.
    """
    letter = "H" if known.dtype() == "<u2" else "I"

    def packed(ids: list[int]) -> bytes:
        made = array(letter, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        first, second = byte_level_encoder(known), SentencePieceProcessor(model_proto=known.pieces)
        aligner = Aligner(known)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in _slices(list(map(len, texts)), BATCH_CHARS):
                part, rows = texts[start:stop], []
                for text, x, y in zip(part, first([" " + t for t in part]), second.encode(part, num_threads=1)):
                    whole = b" " + text.encode()
                    same = text and b"".join(map(known.b.__getitem__, y)) == whole
                    # Files of the usual kind cut a text into tokens without changing it.
                    same = same and (known.ranks is not None or b"".join(map(known.a.__getitem__, x)) == whole)
                    x, y = (packed(ids if same else []) for ids in (x, y))
                    in_a, in_b = aligner.cut(x, y)
                    rows.append((x, y, len(in_a), _narrow(in_a), _narrow(in_b)))
                ids = batch.column(0).slice(start, stop - start)
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                columns = [ids, *(pa.array(values, kind) for values, kind in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in IDS.split(", ")])

    return docs.mapInArrow(scan, IDS)


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each list stand before each common end, in order."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    # Both dictionaries' keys; those of the first come in order.
    common = list(filter(at_b.__contains__, at_a))
    return list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


class Groups(NamedTuple):
    """Places of both lists where each group begins and how many tokens of each it has."""

    start_a: np.ndarray
    start_b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray


def links_of(groups: Groups, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all tokens that share bytes.

    A token alone on its side of a group shares bytes with all of the other side. Where both
    sides have several, each end of a token of either closes a link: that of the tokens
    which cover the byte before it.
    """
    one = (groups.in_a == 1) | (groups.in_b == 1)
    several_a, several_b = groups.in_a[one] > 1, groups.in_b[one] > 1
    size = np.maximum(groups.in_a[one], groups.in_b[one])
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    a = np.repeat(groups.start_a[one], size) + step * np.repeat(several_a, size)
    b = np.repeat(groups.start_b[one], size) + step * np.repeat(several_b, size)
    if one.all():
        return a, b
    ends = [e[np.repeat(~one, size)] for e, size in ((ends_a, groups.in_a), (ends_b, groups.in_b))]
    ends = np.unique(np.concatenate(ends))
    return tuple(np.concatenate([found, np.searchsorted(e, ends)]) for found, e in ((a, ends_a), (b, ends_b)))


def _decimals(count: int) -> np.ndarray:
    """Digits of 0 to ``count`` - 1, a row each, filled up with zero bytes."""
    width = len(str(count - 1))
    return np.array([str(i) for i in range(count)], f"S{width}").view(np.uint8).reshape(count, width)


def described(groups: Groups, a: np.ndarray, b: np.ndarray, digits: np.ndarray) -> str:
    """Groups as ``a1,a2|b1;a3|b2``."""
    total = len(a) + len(b)
    if not total:
        return ""
    letters = np.zeros((total, digits.shape[1] + 1), np.uint8)
    at_a = np.arange(len(a)) + np.repeat(groups.start_b, groups.in_a)
    at_b = np.arange(len(b)) + np.repeat(groups.start_a + groups.in_a, groups.in_b)
    letters[at_a, :-1], letters[at_b, :-1] = digits[a], digits[b]
    letters[:, -1] = ord(",")
    last = np.cumsum(groups.in_a + groups.in_b)
    letters[last - 1, -1] = ord(";")
    letters[last - 1 - groups.in_b, -1] = ord("|")
    return letters[letters != 0].tobytes()[:-1].decode()


class Aligner:
    """Aligns ids, a document at a time."""

    def __init__(self, known: Vocabularies):
        self.dtype, self.other = known.dtype(), len(known.b)
        self.bytes_a, self.bytes_b = (np.array(list(map(len, x)), np.int64) for x in (known.a, known.b))

    def cut(self, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each every group has, from packed ids."""
        a, b = np.frombuffer(a, self.dtype), np.frombuffer(b, self.dtype)
        stops = cuts(np.cumsum(self.bytes_a[a]).tolist(), np.cumsum(self.bytes_b[b]).tolist())
        return tuple(np.diff(np.array(stop, np.int64), prepend=0) for stop in stops)

    def read(self, a: bytes, b: bytes, n: int, in_a: bytes, in_b: bytes) -> tuple[np.ndarray, np.ndarray, Groups, np.ndarray]:
        """Ids of both, the groups, and a number for each link's pair of ids, from packed rows."""
        a, b = np.frombuffer(a, self.dtype).astype(np.int64), np.frombuffer(b, self.dtype).astype(np.int64)
        in_a, in_b = _wide(in_a, n), _wide(in_b, n)
        groups = Groups(np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a, in_b)
        at_a, at_b = links_of(groups, np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b]))
        return a, b, groups, a[at_a] * self.other + b[at_b]


PACKED = ("a", "b", "n_groups", "in_a", "in_b")


def _packed(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in PACKED)))


def pair_counts(ids: DataFrame, known: Vocabularies) -> DataFrame:
    """``(pair, n, best)``: in how many documents a pair is linked, and if no pair of its A id has more.

    Tasks count before they send; an A id has no more pairs than B has ids.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(known)
        held, count = [], 0
        pairs, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *held])
            weights = np.concatenate([numbers, np.ones(len(every) - len(pairs), np.int64)])
            order = np.argsort(every, kind="stable")
            first = runs(every[order])
            return every[order][first], np.add.reduceat(weights[order], first) if len(first) else weights

        for batch in batches:
            for row in _packed(batch):
                found = np.unique(aligner.read(*row)[3])
                held.append(found)
                count += len(found)
                if count > COUNTED_PAIRS:
                    pairs, numbers = merged()
                    held, count = [], 0
                    if len(pairs) > COUNTED_PAIRS:
                        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": numbers})
                        pairs, numbers = pairs[:0], numbers[:0]
        pairs, numbers = merged()
        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": numbers})

    counts = ids.select(*PACKED).mapInArrow(scan, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.floor(F.col("pair") / F.lit(len(known.b))))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


ROW = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"


class Counts:
    """Counts of all pairs, looked up by number; most links are the first best pair of their A id."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, best: np.ndarray, ids: int, other: int):
        self.pairs, self.n, self.best, self.other = pairs, n, best, other
        self.first, self.first_n = np.full(ids, -1, np.int64), np.zeros(ids, np.int64)
        at = np.flatnonzero(best)[::-1]
        self.first[pairs[at] // other], self.first_n[pairs[at] // other] = pairs[at], n[at]

    def of(self, links: np.ndarray) -> tuple[int, int]:
        """How many links are best ones, and the sum of the links' counts."""
        a = links // self.other
        hit = self.first[a] == links
        at = np.searchsorted(self.pairs, np.sort(links[~hit]))
        return int(hit.sum() + self.best[at].sum()), int(self.first_n[a[hit]].sum() + self.n[at].sum())


def aligned(ids: DataFrame, known: Vocabularies, looked_up=None) -> DataFrame:
    """A row for each document; with ``looked_up`` (broadcast :class:`Counts`) also n_best and count_sum."""
    schema = ROW + (", n_best long, count_sum long" if looked_up else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(known)
        digits = _decimals(max(len(known.a), len(known.b)))
        for batch in batches:
            packed = _packed(batch)
            for start, stop in _slices([len(a) + len(b) for a, b, *_ in packed], BATCH_CHARS):
                rows = []
                for own in packed[start:stop]:
                    x, y, groups, links = aligner.read(*own)
                    row = [len(x), len(y), len(groups.in_a), len(links), described(groups, x, y, digits)]
                    if looked_up:
                        row += looked_up.value.of(links)
                    rows.append(row)
                columns = [batch.column("key").slice(start, stop - start), batch.column("doc_id").slice(start, stop - start)]
                columns += [pa.array(v) for v in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in schema.split(", ")])

    return ids.mapInArrow(scan, schema)


def linked_pairs(ids: DataFrame, known: Vocabularies) -> DataFrame:
    """``(key, pair, times)``: each document's pairs and how often it links them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(known)
        for batch in batches:
            for key, row in zip(batch.column("key").to_pylist(), _packed(batch)):
                links = np.sort(aligner.read(*row)[3])
                first = runs(links)
                keys = np.full(len(first), key, np.int64)
                yield pa.RecordBatch.from_pydict({"key": keys, "pair": links[first], "times": run_lengths(first, len(links))})

    return ids.mapInArrow(scan, "key long, pair long, times long")


def align(
    df: DataFrame, byte_level_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """A row for each row of ``df``: how two tokenizers' tokens of its text correspond.

    ``doc_id, n_a, n_b`` (tokens), ``n_groups``, ``groups`` (decimal ids, ``a1,a2|b1;a3|b2``),
    ``n_links``, ``n_best`` (links whose pair is linked in as many documents as any pair of
    its A id) and ``count_sum`` (the sum of those numbers over the links).

    A is a byte-level tokenizers file and encodes a space and the text, B a sentencepiece
    model that adds the space itself. A null or empty text, and one that either tokenizer
    doesn't give back byte for byte, has no tokens: zeros and ''. Every row counts as a
    document of its own, equal rows and rows that share a ``doc_id`` or have none too.
    Other columns are ignored; an empty table gives an empty one.

    Up to ``broadcast_pairs`` different pairs of ids are sent to all tasks; more are joined.
    """
    spark = df.sparkSession
    ship(spark)
    known = vocabularies(byte_level_path, piece_path)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = written(token_ids(docs, known).withColumn("key", F.monotonically_increasing_id()), "ids")
    counts = written(pair_counts(ids, known), "pairs")
    if counts.count() <= broadcast_pairs:
        table = counts.toArrow().sort_by("pair")
        columns = [table.column(name).to_numpy() for name in ("pair", "n", "best")]
        sent = spark.sparkContext.broadcast(Counts(*columns, len(known.a), len(known.b)))
        return aligned(ids, known, sent).drop("key")
    sums = (
        linked_pairs(ids, known)
        .join(counts, "pair")
        .groupBy("key")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    return aligned(ids, known).join(sums, "key", "left").drop("key").fillna(0, ["n_best", "count_sum"])
