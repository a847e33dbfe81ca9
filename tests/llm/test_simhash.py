"""Fingerprints and their links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from twinline.llm import simhash
from twinline.session import written


def plain_fingerprint(text, grams=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + grams]) for i in range(max(1, len(words) - grams + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most):
    """The smallest position that each of ``prints`` reaches."""
    least = list(range(len(prints)))
    while True:
        before = list(least)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= most:
                    least[i] = min(least[i], least[j])
        if least == before:
            return least


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "One", "two words", "a b c d", "A B C D", "a b  c\td", "a b c d e", "ä Ö ü É",
    "x\x1cy z w q", "a b c d e f g h " * 500, "a b c d e f g h " * 499 + "i", "w" * 100_000, "same " * 50, "same " * 51,
]


def test_fingerprints(docs_of):
    found = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs_of(TEXTS)).collect()}
    assert found == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_components_of_documents(docs_of):
    rng = random.Random(5)
    texts = list(TEXTS)
    for _ in range(20):
        words = [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = "changed"
            texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(texts)).collect()}
    want = plain_components([plain_fingerprint(t) for t in texts], 4)
    assert got == dict(enumerate(want))
    assert len(set(want)) < len(want) - 5


@pytest.fixture(scope="module")
def crowd():
    """Fingerprints of which a third are near one, a third share half their bits, and the rest are random."""
    rng = random.Random(11)
    center, half = rng.getrandbits(64), rng.getrandbits(32)
    near = [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)]
    alike = [half << 32 | rng.getrandbits(32) for _ in range(150)]
    return sorted({0, (1 << 64) - 1, *near, *alike, *(rng.getrandbits(64) for _ in range(150)), *(a ^ 5 for a in alike[:20])})


@pytest.mark.parametrize(("most", "tile", "parts"), [(4, 1 << 14, None), (4, 8, None), (4, 8, 5), (4, 30, 3), (2, 8, 2), (0, 50, None), (6, 20, 4)])
def test_links_against_brute_force(spark, crowd, monkeypatch, most, tile, parts):
    if parts:
        monkeypatch.setattr(simhash, "PARTS", (parts,))
    signed = np.array(crowd, np.uint64).view(np.int64).tolist()
    classes = written(spark.createDataFrame([(f,) for f in signed], "fingerprint long"), "classes")
    links = simhash.links_of(classes, most, tile).collect()
    at = {f: i for i, f in enumerate(signed)}
    least = list(range(len(signed)))
    root = lambda i: i if least[i] == i else root(least[i])
    for a, b in links:
        assert a != b
        x, y = sorted((root(at[a]), root(at[b])))
        least[y] = x
    assert [root(i) for i in range(len(signed))] == plain_components(crowd, most)


def test_thresholds_lose_no_link(crowd):
    """Whatever is allotted, any linked pair is within a threshold in some part."""
    prints = np.array(crowd, np.uint64)
    bits = simhash._bits(prints).astype(float)
    together = np.append((bits.T @ bits).ravel(), len(prints))
    for parts in simhash.PARTS:
        groups = simhash.grouped_bits(together, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert max(map(len, groups)) - min(map(len, groups)) <= 1
        atoms = [a for p in simhash.atoms_of(groups) for a in p]
        histograms = np.array([np.bincount(simhash._values(simhash._bits(prints), a), minlength=256) for a in atoms])
        limits, _ = simhash.Plan(groups, histograms, len(prints), 4).thresholds(simhash._bits(prints))
        assert (limits.sum(1) == 4 - parts + 1).all() and limits.min() >= -1
        masks = np.array([sum(1 << b for b in g) for g in groups], np.uint64)
        for f, limit in zip(prints, limits):
            linked = prints[np.bitwise_count(prints ^ f) <= 4]
            assert (np.bitwise_count((linked ^ f)[:, None] & masks) <= limit).any(1).all()
        assert len({tuple(row) for row in limits.tolist()}) > 1


def test_allotment_is_the_cheapest():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    groups = [list(range(0, 20)), list(range(20, 41)), list(range(41, 64))]
    atoms = [a for p in simhash.atoms_of(groups) for a in p]
    bits = simhash._bits(prints)
    histograms = np.array([np.bincount(simhash._values(bits, a), minlength=256) for a in atoms])
    plan = simhash.Plan(groups, histograms, 1e6, 4)
    costs = plan.costs(bits)
    options = [(i, j, 5 - i - j) for i in range(6) for j in range(6 - i)]
    limits, cost = plan.thresholds(bits)
    for row in range(len(prints)):
        every = {tuple(u - 1 for u in o): sum(costs[k][row, u] for k, u in enumerate(o)) for o in options}
        assert np.isclose(every[tuple(limits[row].tolist())], min(every.values())) and np.isclose(cost[row], min(every.values()))


def test_dense_tile_by_pivots(monkeypatch):
    rng = random.Random(2)
    prints = np.array(sorted({sum(1 << b for b in rng.sample(range(40), rng.randint(0, 5))) for _ in range(300)}), np.uint64)
    monkeypatch.setattr(simhash, "PAIRS", 500)
    a, b = simhash.links_in_tile(prints, prints, 4)
    reached = {int(f): int(f) for f in prints}
    reached |= {int(x): int(y) for x, y in zip(a, b)}
    want = plain_components([int(f) for f in prints], 4)
    assert [reached[int(f)] for f in prints] == [int(prints[w]) for w in want]


def test_ids_and_odd_tables(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "quite another text of words", 3), (9, "quite another text of words", 4), (3, None, 5), (7, "", 6), (7, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None), (5, 5), (5, 5), (9, 5), (3, 3), (7, 3), (7, 3)], key=str)
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]
    one = simhash.near_duplicates(df.limit(1)).collect()
    assert len(one) == 1
