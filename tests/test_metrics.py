import math
import os
import pathlib
import random
import subprocess
import sys
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinline.config import ModelSpec
from twinline.operators import encode, metrics, selection, split


@pytest.fixture(scope="module")
def texts(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "prediction string, reference string")

    return build


def test_bleu_bounds(texts):
    same = "rain fell on the old bridge"
    assert metrics.bleu(texts((same, same))).first()["BLEU"] == pytest.approx(100)
    assert metrics.bleu(texts((same, same)).limit(0)).first()["BLEU"] == 0.0
    assert metrics.bleu(texts(("a b c d", "w x y z"))).first()["BLEU"] == 0.0
    assert metrics.bleu(texts(("a b", "a b"))).first()["BLEU"] == 0.0  # no 4-grams
    assert metrics.bleu(texts(("", "a b"), (None, "a"))).first()["BLEU"] == 0.0


def test_bleu_by_hand(texts):
    # Matches 5/6, 3/5, 1/4 and none of 3 four-grams, which counts as 1/(2*3).
    p, r = "two boats drift past a pier".split(), "two boats drift slowly past a pier".split()
    row = metrics.bleu(texts((" ".join(p), " ".join(r)))).first()
    logs, smooth = 0.0, 1
    for n in (1, 2, 3, 4):
        a = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
        b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        match, total = sum((a & b).values()), len(p) - n + 1
        assert (row[f"match_{n}"], row[f"total_{n}"]) == (match, total)
        if match == 0:
            smooth *= 2
            match = 1 / smooth
        logs += math.log(match / total) / 4
    assert row["match_4"] == 0
    assert row["BLEU"] == pytest.approx(100 * math.exp(1 - 7 / 6) * math.exp(logs))


def test_clipping(texts):
    row = metrics.bleu(texts(("so so so", "so far so"))).first()
    assert (row["match_1"], row["total_1"], row["sys_len"], row["ref_len"]) == (2, 3, 3, 3)


@pytest.mark.parametrize(
    "given, tokens",
    [
        ("Hello, world.", "Hello , world ."),
        ("1,000.5 is 3-4", "1,000.5 is 3 - 4"),
        ("a-\nb\nc", "ab c"),
        ("say &quot;x&quot; &amp; y<skipped>", 'say " x " & y'),
        ("it's (ok)...", "it's ( ok ) . . ."),
        ("রোগ। হয়", "রোগ। হয়"),
    ],
)
def test_13a(spark, given, tokens):
    from pyspark.sql import functions as F

    spaced = spark.createDataFrame([(given,)], "t string").select(metrics.spaced_13a(F.col("t"))).first()[0]
    assert spaced.split() == tokens.split()


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_agrees_with_the_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert metrics._lcs_length(a, b) == lcs(a, b)


def test_rouge_l(texts):
    score = lambda df, t="unicode": metrics.rouge_l(df, tokenizer=t).first()[0]
    assert score(texts(("ten green bottles", "ten green bottles"))) == 1.0
    bangla = texts(("নদীর জল", "নদীর জল"))
    assert score(bangla) == 1.0 and score(bangla, "ascii") == 0.0
    assert score(texts(("A b, c!", "a x c"))) == pytest.approx(2 / 3)
    assert score(texts(("a", "a")).limit(0)) == 0.0
    assert score(texts(("", "a"), (None, None))) == 0.0
    with pytest.raises(ValueError):
        score(bangla, "other")


def test_distinct_n(texts):
    value = lambda n, *t: metrics.distinct_n(texts(*[(x, "") for x in t]), n).first()[0]
    assert value(1, "a b a") == pytest.approx(2 / 3)
    assert value(2, "a", "a b a b") == pytest.approx(2 / 3)
    assert value(2, "a") == 0.0
    assert value(1, "a b", "a b") == 1.0  # within each text
    assert metrics.distinct_n(texts(("a", "a")).limit(0), 1).first()[0] == 0.0


def test_semantic_similarity(spark):
    schema = "pair_id int, embedding array<float>"
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], schema)
    b = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 0.0])], schema)
    assert metrics.semantic_similarity(a, b).first()[0] == pytest.approx(0.70710678 / 2)
    assert metrics.semantic_similarity(a.limit(0), b).first()[0] == 0.0
    assert tuple(metrics.semantic_similarity(a, b).first())[1] == 1  # 3 has no prediction
    assert tuple(metrics.semantic_similarity(b, a, name="x").first())[1] == 1 and metrics.semantic_similarity(a, a).first()[1] == 0
    c = spark.createDataFrame([("m", 1, [1.0]), ("n", 2, None)], "model string, pair_id int, embedding array<float>")
    by = metrics.semantic_similarity(c, c, ("model", "pair_id"), ("model",)).collect()
    assert sorted(map(tuple, by)) == [("m", 1.0, 0), ("n", 0.0, 1)]


def test_greedy_match(spark):
    schema = "prediction_tokens array<array<float>>, reference_tokens array<array<float>>"
    one = spark.createDataFrame([([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]])], schema)
    assert metrics.greedy_match_f1(one).first()[0] == pytest.approx(2 / 3)  # P = 1, R = 1/2
    none = spark.createDataFrame([([], [[1.0, 0.0]]), (None, None)], schema)
    assert metrics.greedy_match_f1(none).first()[0] == 0.0


def test_runs(spark):
    rows = [("a", 1, "s", "two boats drift past a pier", "two boats drift past a pier"), ("b", 1, "s", "w x y z", "two boats")]
    triples = spark.createDataFrame(rows, "model_key string, id int, source string, prediction string, reference string")
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0])], "model_key string, pair_id int, embedding array<float>")
    inputs = {"embeddings": {"semsim_mpnet": (vectors, vectors), "semsim_bnsbert": (vectors, vectors)}}
    summary = metrics.evaluate_all(triples, **inputs)
    scores = {r["model_key"]: r for r in summary.collect()}
    assert scores["a"]["BLEU"] == pytest.approx(100) and scores["a"]["ROUGE-L"] == 1.0
    assert scores["a"]["semsim_mpnet"] == 1.0 and scores["a"]["semsim_bnsbert"] == 1.0
    assert scores["b"]["BLEU"] == 0.0 and scores["b"]["semsim_mpnet"] is None
    assert "BERTScore" not in summary.columns
    assert metrics.evaluate_run(triples, "a", **inputs).collect() == [scores["a"]]
    named = metrics.evaluate_all(triples, embeddings={"e1": (vectors, vectors), "e2": (vectors, vectors)})
    assert named.columns[-2:] == ["e1", "e2"]
    table = {r["metric"]: r for r in metrics.compare_runs(summary).collect()}
    assert set(table) == {"BLEU", "ROUGE-L", "Distinct-1", "Distinct-2", "semsim_mpnet", "semsim_bnsbert"}
    assert table["ROUGE-L"]["a"] == 1.0 and table["Distinct-1"]["b"] == 1.0


def test_encoding(pairs):
    df = pairs((1, "b a b", "a c"), (2, "a d", "b"))
    vocab = encode.build_vocab(df, 2)
    assert {(r["token"], r["token_id"]) for r in vocab.collect()} == {("a", 3), ("b", 4)}
    rows = {r["id"]: r for r in encode.encode_pairs(df, vocab, "paraphrase: ", 5, 3).collect()}
    assert rows[1]["input_ids"] == [2, 4, 3, 4, 0]
    assert rows[1]["attention_mask"] == [1, 1, 1, 1, 0]
    assert rows[1]["labels"] == [3, 1, 0]
    assert rows[2]["input_ids"] == [2, 3, 1, 0, 0]
    cut = encode.encode_pairs(df, vocab, "", 2, 1).filter("id = 1").first()
    assert cut["input_ids"] == [4, 3] and cut["labels"] == [3]


def test_a_vocabulary_of_any_size(spark, pairs):
    """Beyond the broadcast limit ids come from a join, and are the same."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), "\u2003".join(rng.choices(words, k=9))) for i in range(300)]
    df = pairs(*rows, (300, None, "w1 w1"), (301, "w5 paraphrase: w6", None), (301, "w5 paraphrase: w6", None), (None, "the " * 50, ""))
    vocab = encode.build_vocab(df, 2000)
    assert vocab.count() == 2000
    for prefix in ("paraphrase: ", ""):
        ways = [encode.encode_pairs(df, vocab, prefix, 20, 8, dictionary_rows=n) for n in (2000, 1999)]
        plans = [way._jdf.queryExecution().executedPlan().toString() for way in ways]
        assert "Python" in plans[0] and "Python" not in plans[1]
        small, large = (sorted(way.collect(), key=str) for way in ways)
        assert small == large and len(small) == 304
    specs = (ModelSpec("t5", "google/mt5-small"), ModelSpec("bart", "facebook/mbart-large-50"))
    dealt = df.withColumn("split", F.lit("train"))
    ways = [encode.encode_all(dealt, vocab, specs, None, 20, 8, dictionary_rows=n) for n in (10**5, 0)]
    assert sorted(ways[0].collect(), key=str) == sorted(ways[1].collect(), key=str)
    assert encode.encode_pairs(df.limit(0), vocab, "", dictionary_rows=0).count() == 0


def test_top_counts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"t{i:05d}", rng.choice([1, 1, 1, 1, 2, 3, rng.randint(1, 10**6), 2**40 + i])) for i in range(4000)]
    counted = spark.createDataFrame(rows, "token string, count long").repartition(7).cache()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    monkeypatch.setattr(selection, "FEW_ROWS", 40)
    monkeypatch.setattr(selection, "RANGES", 8)
    monkeypatch.setattr(selection, "LOOKED_AT", 200)
    for k in (0, 1, 7, 900, 1777, 3999, 4000, 5000):
        got = sorted((tuple(r) for r in selection.top_counts(counted, k).collect()), key=lambda r: (-r[1], r[0]))
        assert got == want[:k]
    assert selection.top_counts(counted.limit(0), 5).count() == 0


def test_groups_of_counts_keep_their_order(spark):
    counts = sorted({1, 2, 3, *(2**n + d for n in range(1, 62) for d in (-1, 0, 1)), 2**63 - 1})
    rows = spark.createDataFrame([(c,) for c in counts], "count long").select("count", selection._group(F.col("count")).alias("g")).collect()
    groups = [r["g"] for r in sorted(rows)]
    assert groups == sorted(groups) and max(groups) < 60 * 2048 and len(set(groups[:200])) > 20


def test_encode_all(pairs):
    df = split.split_rows(pairs(*[(i, f"word{i} a b", "a b") for i in range(20)]))
    specs = (ModelSpec("t5", "google/mt5-small"), ModelSpec("bart", "facebook/mbart-large-50"))
    encoded = encode.encode_all(df, encode.build_vocab(df, 10), specs, max_input_length=6, max_target_length=4)
    assert encoded.count() == 40
    first = {r["model_key"]: r["input_ids"] for r in encoded.filter("id = 7").collect()}
    assert first["t5"][0] == 2 and first["t5"][1:5] == first["bart"][:4]
    codes = {(r["model_key"], r["src_lang"], r["tgt_lang"]) for r in encoded.collect()}
    assert codes == {("t5", None, None), ("bart", "bn_IN", "bn_IN")}
    assert encode.encode_all(df, encode.build_vocab(df, 10), specs, "bart").count() == 20
    with pytest.raises(ValueError):
        encode.encode_all(df, encode.build_vocab(df, 10), specs, "other")


def test_scores_from_another_folder(tmp_path):
    """Workers find the functions although the session was not started in the repository."""
    script = tmp_path / "job.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {str(pathlib.Path(__file__).resolve().parents[1])!r})\n"
        "from twinline.session import local_session\n"
        "from twinline.operators import metrics\n"
        "spark = local_session(2, 2, '1g')\n"
        "df = spark.createDataFrame([('a b c d', 'a b c d', [[1.0]], [[1.0]])],\n"
        "    'prediction string, reference string, prediction_tokens array<array<float>>, reference_tokens array<array<float>>')\n"
        "print(metrics.bleu(df).first()['BLEU'], metrics.rouge_l(df).first()[0], metrics.greedy_match_f1(df).first()[0])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [round(float(x), 6) for x in done.stdout.split()] == [100.0, 1.0, 1.0], done.stderr[-2000:]


def test_text_scores_in_one_function(spark):
    """All statistics of texts come from one function of each batch, and are those of the single scores."""
    texts = ["a b a b", "one, two... 3.5-4 (x)", "", None, "a\u00a0b\x1cc", "the end."]
    rows = [("m", i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "model_key string, id int, prediction string, reference string")
    by = ("model_key",)
    scores = metrics.text_scores(df)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = scores.first().asDict()
    single = [metrics.bleu(df, by), metrics.rouge_l(df, by), metrics.distinct_n(df, 1, by), metrics.distinct_n(df, 2, by)]
    want = {k: v for one in single for k, v in one.first().asDict().items() if k in got}
    assert set(want) == set(got) and all(got[k] == (v if k == "model_key" else pytest.approx(v)) for k, v in want.items())


def test_each_word_of_a_batch_is_cut_once(monkeypatch):
    """Runs that share references, and words that recur, cost no more rules than different words there are."""
    rng = random.Random(12)
    words = ["boat", "boat,", "3.5", "3.", "x-1", "(ok)", "it's", "...", "&amp;a", "é.", "1,5,"]
    references = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(20)] + [None]
    rows = [(p, r) for r in references for p in (r, " ".join(rng.choices(words, k=6)), "")]
    p, r = (pd.Series(side, dtype=object) for side in zip(*rows))
    cut, pieces = [], metrics._pieces_13a
    monkeypatch.setattr(metrics, "_pieces_13a", lambda word: cut.append(word) or pieces(word))
    got = metrics.text_statistics.func(p, r, p, r)
    assert len(cut) == len(set(cut)) <= len(words) + 1
    for (a, b), row in zip(rows, got.itertuples()):
        x, y = (metrics._tokens_13a(t) for t in (a, b))
        plain = (a or "").split()
        for n in (1, 2, 3, 4):
            left, right = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
            assert getattr(row, f"match_{n}") == sum((left & right).values())
        assert (row.sys_len, row.ref_len, row.unique_1, row.grams_2) == (len(x), len(y), len(set(plain)), max(0, len(plain) - 1))
        assert row.unique_2 == len(set(zip(plain, plain[1:])))
