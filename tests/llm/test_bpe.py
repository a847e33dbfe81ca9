"""BPE against the tokenizers library and its own definition."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from twinline.llm import bpe
from twinline.llm.queries import tokenizer_path

TEXTS = [
    None, "", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "\x1c\x1d x", "aaaaaaaaaaaaaaaaaaaaaa " * 3, "日本語テキスト 😀😀😀   x",
    "I'm 'll don't'", "\n\n\n  \t x", "\u0085y\u00a0z", "x" * 5000, "    " * 100, "é" * 300, "한국어 शब्द 123 4½", "<|endoftext", "word " * 20_000,
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokenizer_path(), "rb") as f:
        return bpe.Vocabulary(f.read())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_matches_the_library(spark):
    library = Tokenizer.from_file(tokenizer_path())
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    rows = bpe.encode_decode(df, tokenizer_path()).collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert ids(row.ids) == want
        assert row.decoded == library.decode(want, skip_special_tokens=False) == (row.text or "")


def test_encode_then_decode_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    coded = bpe.encode(df, tokenizer_path())
    back = {r.doc_id: r.decoded for r in bpe.decode(coded, tokenizer_path()).collect()}
    assert back == {1: "some text", 2: ""}
    assert bpe.encode_decode(df.limit(0), tokenizer_path()).count() == 0


def test_trie_walk_is_the_definition(vocabulary):
    rng = random.Random(2)
    words = {"".join(rng.choice("aabcdehinort st'") for _ in range(rng.randint(1, 14))) for _ in range(2000)}
    for word, packed in vocabulary.encode_words(words):
        assert ids(packed) == vocabulary.merged(word.encode())


def test_pairs_follow_the_definition(vocabulary):
    rng = random.Random(3)
    for _ in range(3000):
        a, b = rng.randrange(50_000), rng.randrange(50_000)
        together = vocabulary.merged(vocabulary.token_bytes[a] + vocabulary.token_bytes[b])
        assert vocabulary.can_follow(a, b) == (together == [a, b])


def test_small_caches_change_nothing(vocabulary, monkeypatch):
    texts = ["the quick brown fox " * 5, "the slow green turtle"] * 3
    want = vocabulary.encode(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 2)
    vocabulary.follows.clear()
    assert [vocabulary.encode([t])[0] for t in texts] == want


def test_a_vocabulary_and_a_slice_stay_small(vocabulary):
    # Two workers of an executor hold one each: a token's entry is one object, and slices are short.
    entries = {}
    for fitting in vocabulary.endings.values():
        for entry in fitting:
            assert entries.setdefault(entry[0], entry) is entry
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 20_000] * 100})
    parts = list(bpe._slices(batch, "text"))
    assert sum(p.num_rows for p in parts) == 100
    assert max(p.num_rows for p in parts) * 100_000 <= 3 << 20
