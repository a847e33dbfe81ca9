"""Similarity join, components, neighbours and leaks against brute force."""

import random
import types

import numpy as np
import pyarrow as pa
import pytest

from twinline.llm import decontaminate, multi_index, ngram_join
from twinline.llm.components import components


def near_copies(seed, count):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and") if rng.random() < 0.3 else "w" + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    out = [None, "", " \t", "one", "one two", "ONE  two", "a b c d", "a b c d a b c d", "x " * 500]
    bases = [[word() for _ in range(rng.randint(4, 120))] for _ in range(count // 6)]
    for _ in range(count):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 80))]
        if rng.random() < 0.2:
            words += passage
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    return out


def classes(texts, grams, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + grams]) for i in range(len(w) - grams + 1)} if len(w) >= grams else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed, grams, percent, index", [(1, 4, 85, 20_000), (2, 2, 60, 7), (3, 5, 80, 20_000), (4, 1, 50, 3)])
def test_similar_documents(docs_of, monkeypatch, seed, grams, percent, index):
    texts = near_copies(seed, 150)
    monkeypatch.setattr(ngram_join, "HEAP_ENTRIES", 10 if seed % 2 else 400)
    got = ngram_join.similar_documents(docs_of(texts), grams, percent, index_sets=index).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(texts, grams, percent)


def test_no_search_outgrows_a_task(docs_of, monkeypatch):
    # Near copies that all differ, some of them of another passage, in one large component.
    rng = random.Random(5)
    passages = [[f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(2)]
    passages[1][:30] = passages[0][:30]
    texts = [" ".join(passages[i % 10 == 0][:59] + [f"x{i}"]) for i in range(300)]
    groups, whole = [], ngram_join.search

    def spied(members, *args):
        groups.append([r[0] for r in members.selectExpr("component", "explode(tiles) tile").groupBy("component", "tile").count().select("count").collect()])
        return whole(members, *args)

    monkeypatch.setattr(ngram_join, "search", spied)
    got = ngram_join.similar_documents(docs_of(texts), 2, 70, index_sets=30).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(texts, 2, 70)
    assert max(map(max, filter(None, groups))) <= 4 * 30
    assert sum(map(sum, groups)) < 300 * 10 / 2  # and not each set in each block


def test_no_search_outgrows_a_task_by_long_texts(docs_of, monkeypatch):
    # Few sets, but long ones: a family of near copies, one that has half of its words, and texts with one passage of it.
    monkeypatch.setattr(ngram_join, "INDEX_GRAMS", 1000, raising=False)
    monkeypatch.setattr(ngram_join, "HELD_GRAMS", 700, raising=False)
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base = [word() for _ in range(200)]
    other = base[:100] + [word() for _ in range(100)]
    texts = [" ".join((other if i % 5 == 0 else base)[:199] + [f"x{i}"]) for i in range(30)]
    texts += [" ".join(base[:12] + [word() for _ in range(188)]) for _ in range(30)]
    held, whole = [], ngram_join.search

    def spied(members, *args):
        tiles = members.selectExpr("doc_id", "component", "explode(tiles) tile").collect()
        grams = {}
        for r in tiles:
            grams[r.component, r.tile] = grams.get((r.component, r.tile), 0) + len(texts[r.doc_id].split()) - 1
        held.append(grams)
        return whole(members, *args)

    monkeypatch.setattr(ngram_join, "search", spied)
    got = ngram_join.similar_documents(docs_of(texts), 2, 70).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(texts, 2, 70)
    assert len(held) == 4  # small components, pieces, classes, tiles
    assert max(max(x.values(), default=0) for x in held) <= 4 * 1000


def test_only_shared_grams_are_left(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD_GRAMS", 60)
    rng = random.Random(12)
    rows = []
    for i in range(60):
        known = [rng.randint(0, 90) for _ in range(rng.randint(0, 30))]
        fresh = [1000 * (i + 1) + k for k in range(rng.randint(1, 12))]
        rows.append((i - (i == 59), i % 3, np.unique(np.array(known + fresh, np.uint64))))  # two sets have one id
    df = spark.createDataFrame([(i, c, len(g), bytearray(g.tobytes())) for i, c, g in rows], "doc_id long, component long, n_shingles long, grams binary")
    got = ngram_join.shared_grams(df.repartition(2), 60, 5).collect()
    want = []
    for at, (i, c, g) in enumerate(rows):
        others = set().union(*(set(h.tolist()) for k, (_, d, h) in enumerate(rows) if d == c and k != at))
        left = len(others & set(g.tolist()))
        if left and 100 * left >= 60 * len(g):
            want.append((i, len(g), left))
    assert sorted((r.doc_id, r.n_shingles, len(r.grams) // 8) for r in got) == sorted(want)
    assert 0 < len(want) < 60


def test_tiles_bring_all_classes_together(spark):
    rows = [(i, 0, 0 if i % 3 else i % 7 + 1) for i in range(200)]
    got = ngram_join.in_tiles(spark.createDataFrame(rows, "doc_id long, component long, class long"), 10).collect()
    met = {}
    for r in got:
        for tile in r.tiles:
            met.setdefault(tile, []).append((r.doc_id, r["class"], tile // ngram_join.SLICES == r.own))
    pairs = {(a[0], b[0]) for tile in met.values() for a in tile for b in tile if a[2] and a[1] != b[1]}
    assert all((a, b) in pairs or (b, a) in pairs for a, _, x in rows for b, _, y in rows if x != y)
    assert max(map(len, met.values())) <= 4 * 10


def test_order_of_grams_changes_nothing(docs_of, monkeypatch):
    texts = near_copies(9, 120)
    monkeypatch.setattr(ngram_join, "COMMON_COUNT", 2)
    got = ngram_join.similar_documents(docs_of(texts), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(texts, 4, 85)


def test_texts_are_taken_in_small_slices(monkeypatch):
    """Grams come from a few texts at a time, whatever the batch holds, and are those of each text alone."""
    rng = random.Random(13)
    texts = [" ".join(rng.choices(["ab", "cde", "F", "ghij"], k=rng.randint(0, 400))) for _ in range(1200)] + [None]
    held, words = [], ngram_join.words
    monkeypatch.setattr(ngram_join, "words", lambda data, *more, **kinds: held.append(len(data)) or words(data, *more, **kinds))
    got = list(ngram_join.gram_sets(pa.array(texts), 3))
    assert sum(held) > 5 * max(held)
    assert [row for row, _ in got] == list(range(len(texts)))
    for row, found in got[::97] + got[-1:]:
        assert found.tolist() == next(ngram_join.gram_sets(pa.array([texts[row]], pa.string()), 3))[1].tolist()


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (6, None), (4, "p q r s"), (7, "p q r s"), (4, "x y z u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_documents(df).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [
        (-1, 2, -1), (3, 2, 3), (3, 2, 3), (4, 1, 4), (4, 1, 4), (5, 2, 3), (6, 0, 6), (7, 1, 4),
    ]
    assert ngram_join.similar_documents(df.limit(0)).count() == 0


def test_t_occurrence_counts(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    index = ngram_join.Index(sets)
    for heap in (0, 10**6):
        monkeypatch.setattr(ngram_join, "HEAP_ENTRIES", heap)
        for found in sets[:20]:
            for least in (1, 3, 10):
                places, counts = index.occurring(found, least, np.ones(50, bool))
                want = {i: len(np.intersect1d(s, found)) for i, s in enumerate(sets)}
                assert dict(zip(places.tolist(), counts.tolist())) == {i: n for i, n in want.items() if n >= least}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300), (50, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200, 50: 50, 60: 50}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int")


def brute(rows, k):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in usable.items():
        near = [(-(v @ w) / np.sqrt((v @ v) * (w @ w)), i) for i, w in usable.items() if i != q]
        out[q] = sorted((round(s, 12), i) for s, i in near)[:k]
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), 0, 1) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0], 0, 1) for i in range(20)]  # copies
    rows += [(200, None, 0, 1), (201, [0.0] * 5, 0, 1), (202, [1.0, None, 1.0, 1.0, 1.0], 0, 1), (203, [float("nan")] * 5, 0, 1),
             (204, [float("inf")] * 5, 0, 1), (205, [], 0, 1), (None, [1.0] * 5, 0, 1), (206, [1.0, 2.0], 0, 1), rows[3]]
    df = vectors(spark, rows)
    got = {}
    for r in multi_index.nearest_neighbours(df, df.filter("vec_id % 5 = 0"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([r for r in rows if r[0] != 206], 3)
    assert set(got) == {i for i in want if i % 5 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3]
        assert [f[1] for f in found] == [i for _, i in want[q]]
        assert np.allclose([f[2] for f in found], [-s for s, _ in want[q]], atol=1e-9)


def test_recall_with_the_registered_settings(spark):
    """On vectors without any structure, which are the hardest, and more than are searched in full."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(16_000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest_neighbours(df, df.filter("vec_id % 200 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 16_000, 200):
        scores = unit @ unit[q]
        scores[q] = -2
        hit += len(got[q] & set(np.argsort(-scores)[:5].tolist()))
    assert 0.9 <= hit / 400 < 1  # not a search of everything


def test_fewer_vectors_than_neighbours_and_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 0, 0), (1, [0.5, 0.5], 0, 0)])
    rows = multi_index.nearest_neighbours(df, df, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(0, 1, 1), (1, 1, 0)]
    assert multi_index.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_recall_beyond_the_exact_size(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + 0.8 * rng.normal(size=16)).tolist(), 0, 0) for i in range(3000)]
    df = vectors(spark, rows)
    got = {}
    for r in multi_index.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), 5, candidates=300).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for _, i in near} for q, near in brute(rows, 5).items() if q % 50 == 0}
    assert sum(len(got[q] & w) for q, w in want.items()) / (5 * len(want)) >= 0.9


def test_cells_come_nearest_first():
    rng = np.random.default_rng(2)
    cells = multi_index.Cells(rng.normal(size=(6, 4)), rng.normal(size=(6, 4)))
    sizes = {c: 1 for c in range(36) if c % 5}
    for vector, found in zip(v := rng.normal(size=(5, 8)), cells.nearest(v, sizes, 10**9)):
        a, b = cells.halves(vector[None])
        far = (multi_index._distances(a, cells.left)[0][:, None] + multi_index._distances(b, cells.right)[0]).ravel()
        assert found == [c for c in np.argsort(far).tolist() if c in sizes]


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_against_edit_distance(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    items = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(12)] + [items_ := "Abc Défg", "", None, "hij"]
    assert items_
    texts = [None, "", "abc  DÉFG", "hi hij"]
    for _ in range(60):
        inner = list(rng.choice(items[:12]))
        for _ in range(rng.randint(0, max(1, len(inner) // 7))):
            at = rng.randrange(len(inner))
            inner[at : at + 1] = rng.choice([[], ["q"], [inner[at], "q"]])
            inner = inner or ["q"]
        texts.append("".join([word() + " " for _ in range(rng.randint(0, 20))]) + "".join(inner) + " " + word())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    canonical = lambda t: " ".join(t.lower().split())
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            if t and item:
                raw = canonical(item).encode()
                k = decontaminate.edit_budget(len(raw), 0.1, decontaminate.GRAM)
                distance = edit_distance(raw, canonical(t).encode())
                if distance <= k:
                    want.add((i, j, distance))
    for block in (10**6, 50):
        got = decontaminate.leaks(docs, table, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.n_edits) for r in got} == want
        assert len(got) == len(want) > 20
    one = [r for r in got if r.item_id == 12 and r.doc_id == 2]
    assert [(r.start, r.stop) for r in one] == [(0, len("abc  DÉFG".encode()))]
    assert decontaminate.leaks(docs.limit(0), table).count() == decontaminate.leaks(docs, table.limit(0)).count() == 0


def test_copies_without_edits_take_no_table(monkeypatch):
    """An exact copy is one diagonal of equal bytes; only others are aligned row by row."""
    rows = []
    watched = types.SimpleNamespace(**vars(np))
    watched.maximum = types.SimpleNamespace(accumulate=lambda x: rows.append(1) or np.maximum.accumulate(x))
    monkeypatch.setattr(decontaminate, "np", watched)
    flat = lambda t: np.frombuffer(t.encode(), np.uint8)
    pattern = "the quick brown fox jumps over it"
    for text, low, width, want in (
        (f"xx {pattern} {pattern}", 0, 40, (0, 3, 3 + len(pattern))),
        (f"xx {pattern}", 0, 3, None),  # it lies beyond the band
        (f"xx {pattern.replace('brown', 'br0wn')} yy", 0, 6, (1, 3, 3 + len(pattern))),
    ):
        rows.clear()
        assert decontaminate._banded(flat(pattern), flat(text), low, width, 3 if want else 0) == want
        assert bool(rows) == (want is None or want[0] > 0)
