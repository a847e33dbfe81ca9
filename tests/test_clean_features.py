import random

import pytest
from pyspark.sql import functions as F

from twinline.columns import FEATURES, SL, SOURCE, TARGET
from twinline.functions import editing
from twinline.operators import clean, features


def kept(df):
    return [r[SL] for r in df.orderBy(SL).collect()]


def test_clean_pairs_keeps_only_usable_pairs(pairs):
    df = pairs(
        (1, "one two three", "three two one"),
        (2, "green tea pot", " green  tea pot "),
        (3, None, "three two one"),
        (4, "one two three", None),
        (5, "\t", "three two one"),
        (6, "one two", "three two one"),
        (7, "one two three", "a b c d e"),
        (8, "Green tea pot", "green tea pot"),
        (9, "sun\x00flower in bloom", "a flower turns sunward"),
    )
    assert kept(clean.clean_pairs(df, 3, 4)) == [1, 8, 9]
    assert clean.clean_pairs(df, 3, 4).filter(f"{SL} = 9").first()[SOURCE] == "sunflower in bloom"


def test_single_filters(pairs):
    df = pairs((1, "a b", "a b"), (2, "", "x"), (3, None, "x"), (4, "a b c", "d"))
    assert kept(clean.drop_null_or_empty(df)) == [1, 4]
    assert kept(clean.drop_trivial(df)) == [2, 4]
    assert kept(clean.length_band(df, 2, 3)) == [1]
    assert kept(clean.length_band(df, 1, 3)) == [1, 2, 4]


def test_script_match(pairs):
    df = pairs((1, "নদীর জল", "x"), (2, "river", "x"), (3, None, "x"))
    assert kept(clean.script_match(df, r"[ঀ-৿]")) == [1]


def test_filters_run_on_a_stream_too(spark, pairs, tmp_path):
    df = pairs((1, "one two three", "three two one"), (2, "a", "b"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        features.add_features(clean.clean_pairs(stream))
        .writeStream.format("memory")
        .queryName("cleaned")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(60)
    assert [r["src_len"] for r in spark.table("cleaned").collect()] == [3]


@pytest.mark.parametrize(
    "name, source, target, expected",
    [
        ("src_len", " a b ", "x", 2),
        ("tgt_len", "x", "a b c", 3),
        ("src_char_len", "কি", "x", 2),
        ("tgt_char_len", "x", "é", 1),
        ("len_ratio", "a b c", "x y", 1.5),
        ("len_ratio", "a b c", None, 0.0),
        ("word_overlap", "A b", "a c", 1 / 3),
        ("word_overlap", None, "a", 0.0),
        ("char_overlap", "kitten", "sitting", 3 / 7),
        ("char_overlap", "é", "e", 1.0),
        ("char_overlap", "same", "same", 0.0),
        ("bn_char_ratio", "কি", "x", 0.0),
        ("bn_char_ratio", "abc", "x", 1.0),
        ("bn_char_ratio", "কি a", "x", 0.5),
    ],
)
def test_features(pairs, name, source, target, expected):
    row = features.add_features(pairs((1, source, target))).first()
    assert row[name] == pytest.approx(expected)


def test_add_features_names(pairs):
    assert set(FEATURES) < set(features.add_features(pairs((1, "a", "b"))).columns)


def test_input_prefix(pairs):
    df = pairs((1, "text", "x")).select(
        features.input_prefix("google/mt5-small"), features.input_prefix("facebook/mBART-large-50")
    )
    assert tuple(df.first()) == ("paraphrase: text", "text")
    codes = [features.language_columns(m) for m in ("google/mt5-small", "facebook/mBART-large-50")]
    row = df.select(*[c.alias(f"{k}{i}") for i, own in enumerate(codes) for k, c in own.items()]).first()
    assert tuple(row) == (None, None, "bn_IN", "bn_IN")


def test_normalising_is_not_repeated_by_later_filters(pairs):
    plan = clean.clean_pairs(pairs((1, "a b c", "d e f")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("enough", [1, 16, 10**6])
def test_edit_distances(monkeypatch, enough):
    monkeypatch.setattr(editing, "ENOUGH", enough)
    rng = random.Random(7)
    left, right = [], []
    for _ in range(300):
        letters = rng.choice(["ab", "abcdeé漢🙂", "".join(map(chr, range(0x4E00, 0x4F00)))])
        a = rng.choices(letters, k=rng.choice([0, 1, 7, 63, 64, 65, 127, 128, 129, 180]))
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices(letters, k=rng.randint(0, 2))
        left.append("".join(a))
        right.append("".join(b) if rng.random() < 0.8 else "".join(rng.choices(letters, k=rng.randint(0, 150))))
    assert editing.distances(left, right).tolist() == [plain_distance(a, b) for a, b in zip(left, right)]
    assert editing.distances([], []).tolist() == []


def test_edit_distances_of_long_texts_and_many_characters(monkeypatch):
    rng = random.Random(8)
    a = "".join(rng.choices("abcd ", k=1500))
    b = a[:400] + "".join(rng.choices("abcd ", k=90)) + a[450:]
    assert editing.distances([a, a, b], [b, a, ""]).tolist() == [plain_distance(a, b), 0, len(b)]
    monkeypatch.setattr(editing, "MOST_BLOCKS", 1)  # now each longer pair by itself
    assert editing.distances([a[:200], "x"], [b[150:400], "y"]).tolist() == [plain_distance(a[:200], b[150:400]), 1]
    monkeypatch.setattr(editing, "MOST_BLOCKS", 16)
    monkeypatch.setattr(editing, "TABLE_WORDS", 64)
    monkeypatch.setattr(editing, "ENOUGH", 1)
    texts = ["".join(rng.choices([chr(c) for c in range(0x3000, 0x9000)], k=rng.randint(60, 140))) for _ in range(30)]
    assert editing.distances(texts, texts[::-1]).tolist() == [plain_distance(x, y) for x, y in zip(texts, texts[::-1])]


def test_texts_of_all_lengths_advance_together(monkeypatch):
    """Pairs of 1 to 12 words of 64 characters take one series of steps, not one for each number of words."""
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcde ", k=64 * (i % 12) + rng.randint(1, 64))) for i in range(120)]
    calls, together = [], editing._together
    monkeypatch.setattr(editing, "_together", lambda *given: calls.append(1) or together(*given))
    monkeypatch.setattr(editing, "ENOUGH", 1)
    got = editing.distances(texts, [t[5:] + "xy" for t in texts])
    assert len(calls) == 1
    assert got.tolist() == [plain_distance(t, t[5:] + "xy") for t in texts]


def test_char_overlap_agrees_with_levenshtein(spark, pairs):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abü ", k=rng.randint(0, 90))), "".join(rng.choices("abü ", k=rng.randint(0, 90)))) for i in range(200)]
    long = "".join(rng.choices("abcdefgh", k=100_000))
    rows += [(900, None, "x"), (901, "x", None), (902, "", ""), (903, long, long[:99_990] + "zzzz")]
    df = pairs(*rows).select("id", features.char_overlap().alias("got"), (F.levenshtein(SOURCE, TARGET) / F.greatest(F.length(SOURCE), F.length(TARGET), F.lit(1))).alias("want"))
    assert all(r.got == r.want for r in df.filter("id < 903").collect())
    assert df.filter("id = 903").select("got").first()["got"] == 10 / 100_000
