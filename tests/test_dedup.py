import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from twinline.columns import ID, SL, SOURCE
from twinline.operators import components, dedup


def ids(df):
    return sorted(r[ID] for r in df.collect())


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b)


def brute_force(rows, t):
    """Ids kept: no row of lower id is similar."""
    dropped = {
        b[0] for a, b in itertools.permutations(rows, 2) if a[0] < b[0] and jaccard(a[1], b[1]) >= t
    }
    return sorted(r[0] for r in rows if r[0] not in dropped)


def test_exact_dedup_keeps_lowest_id(pairs):
    df = pairs((7, "a b", "c"), (3, "a b", "c"), (4, "a b", "d"), (None, "a b", "d"))
    assert sorted((r[ID] is not None, r[ID] or 0) for r in dedup.exact_dedup(df).collect()) == [
        (False, 0),
        (True, 3),
    ]


def test_exact_dedup_skips_nulls_in_the_key(pairs):
    assert dedup.exact_dedup(pairs((1, None, "b"), (2, "b", None))).count() == 1


def test_exact_dedup_limits_each_key_before_the_shuffle(pairs):
    plan = dedup.exact_dedup(pairs((1, "a", "b")))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_anti_join_keeps_null_ids(spark, pairs):
    df = pairs((1, "a", "b"), (2, "a", "c"), (None, "a", "d"))
    drop = spark.createDataFrame([(2,), (None,)], f"{ID} bigint")
    assert sorted(r[SL] for r in dedup.anti_join(df, drop).collect()) == [1, 3]


def test_threshold_and_chain(pairs):
    near = pairs((1, "a b c d e f g h", "x"), (2, "a b c d e f g i", "x"))
    assert ids(dedup.near_dup_exact(near, 0.75)) == [1]
    assert ids(dedup.near_dup_exact(near, 0.8)) == [1, 2]
    # 1 is like 2 and 2 is like 3, but 1 is not like 3: both 2 and 3 go.
    chain = pairs((1, "a b c d e f", "x"), (2, "a b c d e g", "x"), (3, "a b c d h g", "x"))
    assert jaccard("a b c d e f", "a b c d h g") < 0.7 < jaccard("a b c d e f", "a b c d e g")
    assert ids(dedup.near_dup_exact(chain, 0.7)) == [1]


def test_rows_of_one_id_go_together(pairs):
    df = pairs((1, "a b c", "x"), (2, "C b a", "x"), (2, "something else", "x"), (3, "left alone", "x"))
    assert ids(dedup.near_dup_exact(df, 0.9)) == [1, 3]


def test_null_ids_and_texts_stay(pairs):
    df = pairs((1, "a b c", "x"), (None, "a b c", "x"), (2, None, "x"), (3, None, "x"))
    assert len(dedup.near_dup_exact(df, 0.9).collect()) == 4


def corpus(seed, n, vocabulary, longest):
    """Random rows plus copies with a few tokens changed, added or removed."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.sample(words, rng.randint(1, longest))) for _ in range(n)]
    for _ in range(n):
        tokens = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(tokens))
            action = rng.choice(("replace", "insert", "delete"))
            if action == "delete" and len(tokens) > 1:
                tokens.pop(at)
            elif action == "insert":
                tokens.insert(at, rng.choice(words))
            else:
                tokens[at] = rng.choice(words)
        texts.append(" ".join(tokens))
    rng.shuffle(texts)
    return [(i, t, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("t", [0.95, 0.8, 0.6, 0.4])
def test_exact_near_dup_agrees_with_brute_force(pairs, t):
    rows = corpus(int(t * 100), 150, 60, 50)
    assert ids(dedup.near_dup_exact(pairs(*rows), t)) == brute_force(rows, t)


def hot_corpus():
    """A third of the rows are near-copies of one template, a third exact copies."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(80):
        tokens = list(template)
        for at in rng.sample(range(40), rng.randint(1, 4)):
            tokens[at] = f"x{rng.randint(0, 30)}"
        rows.append(" ".join(tokens))
    rows += [" ".join(template)] * 80
    rows += [" ".join(rng.sample(template, 20) + [f"y{i}"]) for i in range(80)]
    rng.shuffle(rows)
    return [(i, t, "x") for i, t in enumerate(rows)]


@pytest.mark.parametrize("t", [0.95, 0.85])
def test_hot_blocks_are_split_and_stay_whole(pairs, monkeypatch, t):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 5)
    rows = hot_corpus()
    assert ids(dedup.near_dup_exact(pairs(*rows), t)) == brute_force(rows, t)


def joined(df, t):
    return {r.id: (r.class_id, r.n_links, r.jaccard_dist) for r in dedup.similarity_self_join(df, t).collect()}


def plain_join(rows, t):
    """Class, number of links and nearest distance of each row, from all pairs."""
    near = {a[0]: {b[0]: 1 - jaccard(a[1], b[1]) for b in rows if a[0] != b[0] and jaccard(a[1], b[1]) >= t} for a in rows}
    least, before = {i: i for i in near}, None
    while least != before:
        before = dict(least)
        least = {i: min([before[i], *(before[j] for j in near[i])]) for i in near}
    return {i: (least[i], len(near[i]), pytest.approx(min(near[i].values())) if near[i] else None) for i in near}


@pytest.mark.parametrize("t", [0.95, 0.85, 0.6])
def test_self_join_loses_no_link(pairs, monkeypatch, t):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(components, "HELD_LINKS", 50)
    rows = hot_corpus()
    assert joined(pairs(*rows), t) == plain_join(rows, t)
    rows = corpus(int(t * 100), 120, 60, 40)
    assert joined(pairs(*rows), t) == plain_join(rows, t)


def test_a_row_that_joins_two_others(pairs):
    """3 is like 1 and like 2, which are not like each other: all are one class."""
    base = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(base[:18]), "x"), (2, " ".join(base[2:]), "x"), (3, " ".join(base), "x"), (4, "other", "x")]
    assert jaccard(rows[0][1], rows[1][1]) < 0.9 <= jaccard(rows[0][1], rows[2][1])
    got = joined(pairs(*rows), 0.9)
    assert got == {1: (1, 1, pytest.approx(0.1)), 2: (1, 1, pytest.approx(0.1)), 3: (1, 2, pytest.approx(0.1)), 4: (4, 0, None)}


def test_near_copies_give_a_row_each(pairs):
    rows = [(i, " ".join(f"w{j}" if j != i else f"x{i}" for j in range(60)), "x") for i in range(100, 140)]
    rows += [(i + 100, t, "x") for i, t, _ in rows[:5]]
    got = joined(pairs(*rows), 0.9)
    assert len(got) == 45 and {c for c, _, _ in got.values()} == {100} and {n for _, n, _ in got.values()} == {44}
    assert all(got[i][2] == 0.0 for i in (100, 200))


def test_self_join_of_odd_rows(spark, pairs):
    df = pairs((1, "a b c", "x"), (None, "a b c", "x"), (2, None, "x"), (2, "c b a", "x"), (3, "", "x"), (4, "", "x"))
    got = sorted((tuple(r) for r in dedup.similarity_self_join(df, 0.9).collect()), key=str)
    assert got == sorted([(1, 1, 1, 0.0), (None, None, 0, None), (2, 2, 0, None), (2, 1, 1, 0.0), (3, 3, 1, 0.0), (4, 3, 1, 0.0)], key=str)
    assert dedup.similarity_self_join(df.limit(0), 0.9).count() == 0
    assert dedup.near_dup_exact(df.limit(0), 0.9).count() == 0


def test_self_join_links_rows_of_one_id(pairs):
    """Both rows 7 are like each other; of both rows 2, which are not, one is like row 1."""
    words = [f"w{i}" for i in range(10)]
    rows = [(7, " ".join(words), "x"), (7, " ".join(words[1:]), "x"), (1, "a b c d e f g h i j", "x"), (2, "a b c d e f g h i", "x"), (2, "far from both", "x")]
    got = [tuple(r) for r in dedup.similarity_self_join(pairs(*rows), 0.9).collect()]
    assert sorted((i, c, n) for i, c, n, _ in got) == [(1, 1, 1), (2, 1, 1), (2, 2, 0), (7, 7, 1), (7, 7, 1)]
    assert all(d is None if n == 0 else d == pytest.approx(0.1) for _, _, n, d in got)


@pytest.mark.parametrize("few", [1, 32])
def test_self_join_of_shared_ids_loses_no_link(pairs, monkeypatch, few):
    """Three rows have the same id: they link as they would with ids of their own."""
    monkeypatch.setattr(dedup, "PAIR_ROWS", few)
    monkeypatch.setattr(components, "HELD_LINKS", 50)
    texts = [t for _, t, _ in corpus(8, 60, 40, 30) + hot_corpus()[:70]]
    alone = plain_join([(i, t, "x") for i, t in enumerate(texts)], 0.8)
    told = dedup.similarity_self_join(pairs(*[(i // 3, t, "x") for i, t in enumerate(texts)]), 0.8).collect()
    got = [(r.id, r.class_id, r.n_links, -1 if r.jaccard_dist is None else r.jaccard_dist) for r in told]
    wanted = [(i // 3, c // 3, n, -1 if d is None else d.expected) for i, (c, n, d) in alone.items()]

    def counted(rows):
        return sorted((i, c, n, round(d, 9)) for i, c, n, d in rows)

    assert counted(got) == counted(wanted)


def test_classes_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(20, 60)] + [(5, 5), (300, 300)] + [(90, 91), (91, 92), (92, 90)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.class_id for r in components.connected_classes(df).collect()}
    assert got == {i: 200 for i in range(200, 261)} | {i: 7 for i in [7, *range(20, 60)]} | {90: 90, 91: 90, 92: 90}


def boilerplate(n, own=5):
    """Rows of 60 common tokens and a few of their own: alike in most words, and not similar at 0.95."""
    shared = " ".join(f"licence{i}" for i in range(60))
    return [(i, shared + "".join(f" own{i}x{j}" for j in range(own)), "x") for i in range(n)]


@pytest.mark.parametrize("t", [0.95, 0.9])
def test_boilerplate_brings_nothing_together(spark, pairs, t):
    """Keys that rows share are what grows with the square of them: there are none, however many rows."""
    rows = boilerplate(500)
    assert jaccard(rows[0][1], rows[1][1]) < 0.9
    sets, keys = dedup.filed_sets(dedup.token_sets(pairs(*rows)), t)
    assert keys.count() > 0 and dedup._blocks(sets, keys).count() == 0
    assert len(ids(dedup.near_dup_exact(pairs(*rows), t))) == 500


def test_boilerplate_with_copies_among_it(pairs):
    rows = boilerplate(120)
    rows += [(1000 + i, t + f" more{i}", "x") for i, t, _ in rows[::10]] + [(2000 + i, t.replace("licence3 ", ""), "x") for i, t, _ in rows[::7]]
    for t in (0.95, 0.85):
        assert ids(dedup.near_dup_exact(pairs(*rows), t)) == brute_force(rows, t)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=14), min_size=2, max_size=25), st.sampled_from([0.95, 0.8, 0.5, 0.34]))
def test_similar_sets_share_a_key(spark, sets, t):
    """The law behind the prefixes, for every pair and any sizes."""
    distinct = sorted({tuple(sorted(set(s))) for s in sets})
    table = spark.createDataFrame([(i, 1, list(map(str, s))) for i, s in enumerate(distinct)], "rep long, copies long, tokens array<string>")
    filed = {}
    for r in dedup.prefix_keys(dedup.rarest_first(table), t).collect():
        filed.setdefault(r.rep, {}).setdefault((r.key, r.side), []).append(r.room)
    for i, j in itertools.combinations(range(len(distinct)), 2):
        a, b = set(distinct[i]), set(distinct[j])
        if len(a & b) / len(a | b) >= t:
            needed = (len(a) + len(b)) * t / (1 + t) - 1e-9
            rooms = [min(x, y) for (k, s), xs in filed[i].items() for y in filed[j].get((k, -s), []) for x in xs]
            assert rooms and max(rooms) >= needed


@pytest.mark.parametrize("t", [0.95, 0.8, 0.6])
def test_a_token_is_filed_once(spark, t):
    """A set files no more than a similar set can lack, whatever sizes partners have, and no token twice."""
    table = spark.createDataFrame([(n, 1, [f"w{n}x{i}" for i in range(n)]) for n in range(1, 90)], "rep long, copies long, tokens array<string>")
    filed = {}
    for r in dedup.prefix_keys(dedup.rarest_first(table), t).collect():
        filed.setdefault(r.rep, []).append(r.key)
    assert len(filed) > 50 and all(len(k) == len(set(k)) <= n - n * t + 1 for n, k in filed.items())


@pytest.mark.parametrize("few", [1, 6, 32])
def test_blocks_of_any_size_lose_no_link(pairs, monkeypatch, few):
    """Small blocks are compared as pairs, large ones as blocks; pairs that meet in both count once."""
    monkeypatch.setattr(dedup, "PAIR_ROWS", few)
    rows = corpus(12, 60, 40, 30) + [(i + 1000, t, "x") for i, t, _ in hot_corpus()[:70]]
    assert joined(pairs(*rows), 0.8) == plain_join(rows, 0.8)
    assert ids(dedup.near_dup_exact(pairs(*rows), 0.8)) == brute_force(rows, 0.8)


def test_lsh_drops_a_part_of_what_exact_drops(pairs):
    rows = corpus(3, 150, 200, 60)
    df = pairs(*rows)
    exact, lsh = ids(dedup.near_dup_exact(df, 0.9)), ids(dedup.near_dup_lsh(df, 0.9))
    published = ids(dedup.near_dup_lsh(df, 0.9, bands=3, rows_per_band=1))
    assert set(exact) <= set(lsh) and set(exact) <= set(published)
    assert len(lsh) < len(rows) and len(lsh) - len(exact) <= 0.1 * (len(rows) - len(exact))


def test_lsh_keeps_its_recall_at_low_thresholds(pairs):
    rows = corpus(5, 150, 30, 12)
    df = pairs(*rows)
    exact, lsh = ids(dedup.near_dup_exact(df, 0.5)), ids(dedup.near_dup_lsh(df, 0.5))
    assert set(exact) <= set(lsh) and len(rows) - len(lsh) >= 0.97 * (len(rows) - len(exact))


def test_equal_sets_are_near_duplicates_at_one(pairs):
    df = pairs((1, "a b c", "x"), (2, "c b a", "y"), (3, "a b c d", "z"))
    assert ids(dedup.near_dup_exact(df, 1.0)) == ids(dedup.near_dup_lsh(df, 1.0)) == [1, 3]
    for wrong in (0.3, 1.1):
        with pytest.raises(ValueError):
            dedup.near_dup_exact(df, wrong)


def test_deduplicate_runs_both_steps(pairs):
    df = pairs((1, "a b c", "x"), (2, "a b c", "x"), (3, "c b a", "y"), (4, "d e f", "z"))
    assert ids(dedup.deduplicate(df)) == [1, 3, 4]
    assert ids(dedup.deduplicate(df, "exact")) == [1, 4]
    assert ids(dedup.deduplicate(df, "lsh")) == [1, 4]
    with pytest.raises(ValueError):
        dedup.near_duplicate_ids(df, method="guess")
    assert df.columns == dedup.deduplicate(df, "exact").columns and SOURCE in df.columns
