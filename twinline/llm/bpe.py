"""Byte-pair encoding and decoding by a prefix-sharing walk over a trie of words.

A text is cut into words by the public pattern of byte-level vocabularies. The
encoding of a word ends in exactly one token that can follow the encoding of what is
before it, so "the last token" of each prefix determines the encoding of the whole.
The distinct words of a batch, sorted, are their trie in depth-first order: the walk
keeps the last token of each prefix on the path, goes back to the branching point, and
goes on from there, so a shared prefix is encoded once.

Tokenizers are read, never trained; the file's content is broadcast (a few MB).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from twinline.llm.flat import give_back
from twinline.session import ship

# Fixed value: the pattern of byte-level vocabularies; white space is Unicode's White_Space.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

# Words, and pairs of tokens, that a worker remembers before it starts anew (some 50 and 30 MB), and bytes of text it handles at once.
CACHE_WORDS = 200_000
CACHE_PAIRS = 250_000
SLICE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's file format."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model = data["model"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in data["added_tokens"])]))
        self.ids: dict[bytes, int] = {}
        for letters, i in model["vocab"].items():
            self.token_bytes[i] = bytes(byte_of[c] for c in letters)
            self.ids[self.token_bytes[i]] = i
        self.ranks: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # the rank at which a token is made of its halves
        for rank, pair in enumerate(model["merges"]):
            left, right = (model["vocab"][half] for half in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[left, right] = rank
            whole = self.ids.get(self.token_bytes[left] + self.token_bytes[right])
            if whole is not None and whole not in self.halves:
                self.halves[whole], self.made[whole] = (left, right), rank
        # Tokens that stand for themselves in a text, before it is cut into words.
        self.added = {a["content"]: a["id"] for a in data["added_tokens"]}
        for content_, i in self.added.items():
            self.token_bytes[i] = content_.encode()
        # For each beginning of a token, the tokens that end where it ends, longest first.
        beginnings = {token[:n] for token in self.ids for n in range(1, len(token) + 1)}
        # A token's entry is one object wherever it ends.
        entry = {token: (i, len(token)) for token, i in self.ids.items()}
        self.endings = {
            text: tuple(entry[text[i:]] for i in range(len(text)) if text[i:] in entry) for text in beginnings
        }
        self.follows: dict[int, bool] = {}  # by left << 32 | right
        self.cache: dict[str, bytes] = {}

    def merged(self, text: bytes) -> list[int]:
        """Encoding by the definition: merge the pair of lowest rank, again and again."""
        parts = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [self.ids[self.token_bytes[parts[at]] + self.token_bytes[parts[at + 1]]]]
        return parts

    def can_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens next to each other are their own encoding.

        They are not if, while either is being made, the piece at the left token's end
        and the piece at the right one's start have a merge that comes first.
        """
        ends, starts = [left], [right]
        while ends[-1] in self.halves:
            ends.append(self.halves[ends[-1]][1])
        while starts[-1] in self.halves:
            starts.append(self.halves[starts[-1]][0])
        never = 1 << 60
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            across = self.ranks.get((ends[i], starts[j]), never)
            grow_left = self.made[ends[i - 1]] if i else never
            grow_right = self.made[starts[j - 1]] if j else never
            if across < grow_left and across <= grow_right:
                return False
            if i == j == 0:
                return True
            if grow_left <= grow_right:
                i -= 1
            else:
                j -= 1

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids (little-endian, 32 bits), walking the trie of the words."""
        endings, token_bytes, follows = self.endings, self.token_bytes, self.follows
        # By length of the path so far: the last token of its encoding, and the length of
        # the longest beginning of a token at its end.
        path, last, longest = b"", [], [0]
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(path), len(raw))
            while shared < most and path[shared] == raw[shared]:
                shared += 1
            del last[shared:], longest[shared + 1 :]
            path, reach = raw, longest[shared]
            for end in range(shared + 1, len(raw) + 1):
                reach += 1
                while (fitting := endings.get(raw[end - reach : end])) is None:
                    reach -= 1
                longest.append(reach)
                for token, length in fitting:
                    if length == end:
                        break
                    pair = last[end - 1 - length] << 32 | token
                    if (good := follows.get(pair)) is None:
                        if len(follows) >= CACHE_PAIRS:
                            follows.clear()
                        good = follows[pair] = self.can_follow(pair >> 32, token)
                    if good:
                        break
                last.append(token)
            ids, end = [], len(raw)
            while end:
                ids.append(last[end - 1])
                end -= len(token_bytes[ids[-1]])
            yield word, _PACK[len(ids)](*reversed(ids)) if len(ids) < len(_PACK) else np.array(ids[::-1], "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        """The text cut at added tokens; these are at the odd places."""
        if not any(a in text for a in self.added):
            return [text]
        longest_first = sorted(self.added, key=len, reverse=True)
        return regex.split("(" + "|".join(map(regex.escape, longest_first)) + ")", text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian, 32 bits each."""
        cut = [[WORDS.findall(p) if i % 2 == 0 else p for i, p in enumerate(self._pieces(t))] for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = {w for text in cut for words in text[::2] for w in words}.difference(cache)
        cache.update(self.encode_words(new))
        ids_of = cache.__getitem__
        return [
            b"".join(
                b"".join(map(ids_of, p)) if i % 2 == 0 else self.added[p].to_bytes(4, "little") for i, p in enumerate(text)
            )
            for text in cut
        ]

    def decode(self, ids: bytes) -> str:
        bytes_of = self.token_bytes.__getitem__
        return b"".join(map(bytes_of, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES, and at least a row."""
    sizes = np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column).cast(pa.large_binary())), np.int64, batch.num_rows)
    groups = np.cumsum(sizes) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _run(df: DataFrame, vocabulary: str, source: str, new: list[StructField], step) -> DataFrame:
    """Add the ``new`` columns that ``step`` makes of the ``source`` column's values."""
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    names = {n.name for n in new}
    kept = [c for c in df.columns if c not in names]
    schema = StructType([*df.select(*kept).schema.fields, *new])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's own: tables of words and of beginnings of tokens take over 100 MB.
        words = Vocabulary(content.value)
        try:
            for batch in batches:
                for part in _slices(batch, source):
                    made = step(words, part.column(source).to_pylist())
                    columns = [part.column(c) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *(n.name for n in new)])
        finally:
            del words
            give_back()

    return df.mapInArrow(convert, schema)


def _encoded(words: Vocabulary, texts: list) -> list[bytes]:
    return words.encode([t or "" for t in texts])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: each whole text's token ids, packed as little-endian 32 bits.

    ``vocabulary`` is the path of the tokenizer's file on the driver. Null counts as
    empty, which has no ids. Rows are independent, so repeats and ties need no rule;
    a column that is named like ``ids`` is replaced.
    """

    def step(words, texts):
        return [pa.array(_encoded(words, texts), pa.binary())]

    return _run(df, vocabulary, text, [StructField(ids, BinaryType())], step)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``, the text of the packed ``ids``; null gives an empty text."""

    def step(words, packed):
        return [pa.array([words.decode(p or b"") for p in packed], pa.string())]

    return _run(df, vocabulary, ids, [StructField(text, StringType())], step)


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, in one pass; see :func:`encode` and :func:`decode`."""

    def step(words, texts):
        packed = _encoded(words, texts)
        return [pa.array(packed, pa.binary()), pa.array([words.decode(p) for p in packed], pa.string())]

    return _run(df, vocabulary, text, [StructField("ids", BinaryType()), StructField("decoded", StringType())], step)
