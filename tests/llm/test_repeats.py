"""Removal of long repeats against brute force."""

import random

import numpy as np
import pytest

from twinline.llm import recompress, suffix_dedup


def texts(seed, count, alphabet):
    """Random texts that share passages, runs and whole copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))
    passage = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    out = [None, "", " ", "x" * 1000, "x" * 150, "ab " * 400, "ab " * 100 + "c", "é" * 200]
    for _ in range(count):
        parts = [rng.choice(passage) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(["", "\n"]).join(parts))
    return out + rng.sample(out, len(out) // 4)


def bytes_removed(rows, length):
    seen, out = set(), {}
    for i, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for at in range(len(body) - length + 1):
            if body[at : at + length] in seen:
                gone[at : at + length] = True
            seen.add(body[at : at + length])
        out[i] = gone
    return out


@pytest.mark.parametrize("seed, length, gram", [(1, 100, 32), (2, 40, 16), (3, 33, 32), (4, 100, 8)])
def test_bytes_against_brute_force(docs_of, seed, length, gram):
    rows = list(enumerate(texts(seed, 40, "ab" if seed == 2 else "abcdefg")))
    want = bytes_removed(rows, length)
    got = suffix_dedup.remove_repeats(docs_of([t for _, t in rows]), length, gram=gram).collect()
    assert len(got) == len(rows)
    for r in got:
        body = np.frombuffer((rows[r.doc_id][1] or "").encode(), np.uint8)
        gone = want[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(body), gone.sum())
        assert bytes(r.kept) == body[~gone].tobytes()
        assert r.score == r.doc_id % 2  # other columns stay


@pytest.mark.parametrize("seed", [1, 5])
def test_hot_minimizers_against_brute_force(docs_of, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 3)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    rows = list(enumerate(texts(seed, 40, "abcdefg")))
    want = bytes_removed(rows, 60)
    got = suffix_dedup.remove_repeats(docs_of([t for _, t in rows]), 60, gram=16).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: gone.sum() for i, gone in want.items()}


def test_a_line_in_many_places_is_not_sorted_in_one_task(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 20, raising=False)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1, raising=False)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(30))
    line = "licensed under the usual terms of this site"
    docs = docs_of([" ".join([word(), word(), word(), word(), line, word(), word(), word(), word()]) for _ in range(300)])
    sent = suffix_dedup.segments(suffix_dedup.repeats.documents(docs, "doc_id", "text"), 100).collect()
    volume = {}
    for r in sent:
        for key, size in zip(np.frombuffer(r.keys, "u8").tolist(), np.frombuffer(r.sizes, "i4").tolist()):
            volume[key] = volume.get(key, 0) + size
    assert max(volume.values()) <= 20 * 168  # of 300 documents with over 100 bytes each
    assert all(r.n_removed == 0 for r in suffix_dedup.remove_repeats(docs).collect())


def test_suffix_array_and_boundaries():
    rng = random.Random(7)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 80))).encode() for _ in range(30)]
    for length in (1, 2, 5, 20):
        flags = suffix_dedup.found_earlier(b"".join(parts), np.array([len(p) for p in parts]), length)
        seen, want = set(), []
        for p in parts:
            for at in range(len(p)):
                piece = p[at : at + length]
                want.append(len(piece) == length and piece in seen)
                if len(piece) == length:
                    seen.add(piece)
        assert flags.tolist() == want


def words_removed(rows, window):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, words in split.items():
        for at in range(len(words) - window + 1):
            first.setdefault(tuple(words[at : at + window]), i)
    for i, words in split.items():
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < i:
                gone[at : at + window] = [True] * window
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("seed, window, rounds", [(1, 50, 4), (2, 12, 4), (3, 20, 2), (4, 50, 0), (5, 30, 4)])
def test_words_against_brute_force(docs_of, seed, window, rounds):
    rows = list(enumerate(texts(seed, 60, "a" if seed == 3 else "abc")))
    want = words_removed(rows, window)
    got = recompress.remove_repeated_words(docs_of([t for _, t in rows]), window, rounds=rounds).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want


def test_equal_strings_hold_equal_symbols():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 50, 60).astype(np.uint64)
    found = []
    for _ in range(20):
        around = [rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64) for _ in range(2)]
        names = np.concatenate((around[0], shared, around[1]))
        symbol, low, high = recompress.symbols(names, np.zeros(len(names), np.int64))
        at = len(around[0])
        inside = (low >= at) & (high <= at + 60)
        found.append(list(zip(symbol[inside].tolist(), (low[inside] - at).tolist(), (high[inside] - at).tolist())))
        assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
    assert found[0] and all(f == found[0] for f in found)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    long_text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, long_text), (5, long_text), (None, long_text), (7, long_text), (8, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed > 0) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(-1, False), (5, False), (5, False), (7, True), (8, False)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in recompress.remove_repeated_words(df).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (7, 300), (8, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == recompress.remove_repeated_words(df.limit(0)).count() == 0
