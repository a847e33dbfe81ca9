import json
import random

import pytest

from twinline.columns import ID, SL, SOURCE, TARGET
from twinline.config import CorpusConfig, ModelSpec
from twinline.plans import corpus
from twinline.sources import files, pairs as pair_files, records, split_csv, stages


def lines(path, *rows):
    path.write_text("\n".join(("sl,id,source_sentence,paraphrased_sentence", *rows)), encoding="utf-8")
    return str(path)


def test_read_pairs(spark, tmp_path):
    path = lines(tmp_path / "p.csv", "1,7,ডেঙ্গু রোগ,রোগ", "x,8,a,b", "3,,c,", '4,9,"q, r",s')
    rows = {r[SOURCE]: r for r in pair_files.read_pairs(spark, path).collect()}
    assert rows["ডেঙ্গু রোগ"][ID] == 7
    assert rows["a"][SL] is None and rows["a"][ID] == 8  # malformed number
    assert rows["c"][ID] is None and rows["c"][TARGET] is None
    assert rows["q, r"][TARGET] == "s"
    bad = pair_files.read_pairs(spark, path, corrupt=True).cache()
    assert [r[pair_files.CORRUPT] for r in bad.filter("_corrupt_record is not null").collect()] == ["x,8,a,b"]
    with pytest.raises(FileNotFoundError):
        pair_files.read_pairs(spark, str(tmp_path / "none.csv"))


def whole_file(spark, path):
    reader = spark.read.option("header", True).option("multiLine", True).option("columnNameOfCorruptRecord", pair_files.CORRUPT)
    return reader.schema(pair_files.pair_schema(True, True)).csv(path)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_breaks_in_many_splits(spark, tmp_path, seed):
    """The rows of Spark's whole-file reader, from several tasks, wherever splits begin."""
    rng = random.Random(seed)

    def field():
        text = "".join(rng.choice(["a", "b ", "é", "\n", "\n\n", ",", '\\"', "x", "\\\\", "漢"]) for _ in range(rng.randint(0, 30)))
        return f'"{text}"' if rng.random() < 0.9 else rng.choice(["plain", "", 'in"side', "a b", '"shut"tail'])

    for n in range(2):
        rows = [f"{i if rng.random() < 0.95 else 'x'},{i},{field()},{field()}" for i in range(150)]
        ends = "\n" if n else ""
        (tmp_path / f"{n}.csv").write_text("sl,id,source_sentence,paraphrased_sentence\n" + "\n".join(rows) + ends, encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(whole_file(spark, str(tmp_path)).collect(), key=str)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = pair_files.read_pairs(spark, str(tmp_path), long_ids=True, multi_line=True, corrupt=True)
        lines_ = split_csv._lines(spark, str(tmp_path))
        assert lines_.select("file", "split").distinct().count() > 8
        assert df.rdd.getNumPartitions() > 8
        assert 0 < len(split_csv.begun_inside(lines_))
        assert sorted(df.collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(want) == 300


def test_line_breaks_round_trip(spark, pairs, tmp_path):
    df = pairs((1, 'two\nlines and "quotes"\n', "a\r\nb"), (2, "\n", None), (3, "plain", "x,\ny"))
    path = pair_files.write_pairs_csv(df, str(tmp_path / "out"))
    again = pair_files.read_pairs(spark, path, long_ids=True, multi_line=True)
    assert sorted(again.collect()) == sorted(df.collect())
    empty = lines(tmp_path / "empty.csv")
    assert pair_files.read_pairs(spark, empty, multi_line=True).count() == 0
    windows = tmp_path / "w.csv"
    windows.write_text('sl,id,source_sentence,paraphrased_sentence\r\n1,2,"a\r\nb",c\r\n\r\n3,4,d,e\r\n', newline="")
    got = pair_files.read_pairs(spark, str(windows), multi_line=True).collect()
    assert [tuple(r) for r in got] == [(1, 2, "a\nb", "c"), (3, 4, "d", "e")]
    assert sorted(got) == sorted(whole_file(spark, str(windows)).drop(pair_files.CORRUPT).collect())


def test_csv_round_trip(spark, pairs, tmp_path):
    df = pairs((1, ' lead "quoted", comma ', "tail "), (2, "back\\slash", None), (2**40, "é", "x"))
    path = pair_files.write_pairs_csv(df, str(tmp_path / "out"))
    again = pair_files.read_pairs(spark, path, long_ids=True)
    assert sorted(again.collect()) == sorted(df.collect())


def test_dev_subset(pairs):
    df = pairs((3, "a", "b"), (2, "c", "d"), (1, "e", "f"))
    assert [r[SL] for r in pair_files.dev_subset(df, 2).collect()] == [1, 2]
    assert pair_files.dev_subset(df, None) is df


def test_output_ready(spark, pairs, tmp_path):
    folder = tmp_path / "t.parquet"
    assert not files.output_ready(spark, str(folder))
    folder.mkdir()
    (folder / "part-0.parquet").write_bytes(b"x")
    assert not files.output_ready(spark, str(folder))  # a write that broke off
    pair_files.write_parquet(pairs((1, "a", "b")), str(folder))
    assert files.output_ready(spark, str(folder))
    single = tmp_path / "one.parquet"
    single.write_bytes(b"x")
    other = tmp_path / "one.csv"
    other.write_bytes(b"x")
    assert files.output_ready(spark, str(single)) and not files.output_ready(spark, str(other))
    with pytest.raises(FileNotFoundError):
        pair_files.read_parquet(spark, str(tmp_path / "absent.parquet"))


def test_stages(spark, pairs, tmp_path):
    folder, out = str(tmp_path / "stages"), str(tmp_path / "o.parquet")
    assert not stages.is_done(spark, folder, "write_pairs")
    stages.mark_done(spark, folder, "write_pairs", "one", {"rows": 3})
    assert stages.is_done(spark, folder, "write_pairs", "one")
    assert not stages.is_done(spark, folder, "write_pairs", "two")  # another config
    assert not stages.is_done(spark, folder, "write_pairs", "one", (out,))  # output missing
    pair_files.write_parquet(pairs((1, "a", "b")), out)
    assert stages.is_done(spark, folder, "write_pairs", "one", (out,))
    record = spark.read.json(stages.stage_path(folder, "write_pairs")).first()
    assert record["stage"] == "write_pairs" and json.loads(record["metadata"]) == {"rows": 3}
    stages.clear_stage(spark, folder, "write_pairs")
    assert not stages.is_done(spark, folder, "write_pairs", "one")


def test_run_metrics_files(spark, tmp_path):
    # As other tools write them: one indented JSON file per model.
    for key, more in (("m1", {"BLEU": 1.5}), ("m2", {"ROUGE-L": 0.5, "BLEU": 2.0})):
        (tmp_path / f"{key}.json").write_text(json.dumps({"model_key": key, **more}, indent=2))
    (tmp_path / "summary.json").write_text(json.dumps({"model_key": "summary"}))
    rows = {r["model_key"]: r for r in records.read_run_metrics(spark, str(tmp_path)).collect()}
    assert set(rows) == {"m1", "m2"} and rows["m1"]["ROUGE-L"] is None and rows["m2"]["BLEU"] == 2.0


def test_train_log(spark, tmp_path):
    for run, entries in (("a", [(2, 0.5), (1, 0.9), (3, None)]), ("b", [(1, None)])):
        folder = tmp_path / f"run={run}"
        folder.mkdir()
        text = [json.dumps({"step": s, "epoch": 1} | ({} if v is None else {"loss": v})) for s, v in entries]
        (folder / "train.jsonl").write_text("\n".join(text))
    rows = [tuple(r) for r in records.read_train_log(spark, str(tmp_path)).collect()]
    assert rows == [("a", 1, 0.9), ("a", 2, 0.5)]


def test_config():
    assert CorpusConfig().fingerprint() != CorpusConfig(seed=1).fingerprint()
    assert CorpusConfig().model("mt5_lora").name == "google/mt5-small"
    for wrong in ({"train_split": 0.9}, {"min_tokens": 0}, {"near_dup_method": "x"}):
        with pytest.raises(ValueError):
            CorpusConfig(**wrong)
    with pytest.raises(ValueError):
        CorpusConfig().model("none")


def test_whole_run(spark, tmp_path):
    def row(i, n):
        return f"{i},{i},নদী {n} বর্ষায় দুই তীর ভাসিয়ে দেয়,বর্ষায় নদী {n} তীর ভাসায়"

    rows = [row(i, i) for i in range(90)]
    rows += ["90,90,একই কথা দুইবার বলা,একই কথা দুইবার বলা", row(91, 4)]  # trivial, and a copy
    csv, base = lines(tmp_path / "in.csv", *rows), str(tmp_path / "base")
    config = CorpusConfig(max_input_length=16, max_target_length=8, models=(ModelSpec("m", "google/mt5-small"),))

    done = corpus.run_preprocess(spark, csv, base, config)
    assert done.count() == 90
    raw = spark.read.json(corpus.output(spark, base, "preprocess", "reports/raw_validation_summary.json")).first()
    assert (raw["total_rows"], raw["stage"], raw["valid"]) == (92, "raw", True)
    clean = spark.read.json(corpus.output(spark, base, "preprocess", "reports/validation_summary.json")).first()
    assert (clean["total_rows"], clean["script_coverage"]) == (90, 1.0)
    before = spark.read.json(f"{base}/stages/preprocess.ok").first()["completed_at"]
    corpus.run_preprocess(spark, csv, base, config)
    assert spark.read.json(f"{base}/stages/preprocess.ok").first()["completed_at"] == before
    done = corpus.run_preprocess(spark, csv, base, config, force=True)
    assert spark.read.json(f"{base}/stages/preprocess.ok").first()["completed_at"] != before

    stats = corpus.run_eda(spark, base, config).first()
    assert stats["total_rows"] == 90 and stats["src_len_mean"] == 7.0 and stats["tgt_len_mean"] == 5.0
    assert stats["top_tokens"][0]["count"] == 90 and stats["vocab_size"] == 96

    train = done.filter("split = 'train'").count()
    assert corpus.run_augment(spark, base, None, config).count() == 2 * train
    assert pair_files.split_source(spark, base, "train", True).count() == 2 * train
    assert pair_files.split_source(spark, base, "train").count() == train
    encoded = corpus.run_encode(spark, base, config)
    assert encoded.count() == 90 and len(encoded.first()["input_ids"]) == 16

    triples = done.selectExpr(
        "'m' as model_key", "id", f"{SOURCE} as source", f"{SOURCE} as prediction", f"{TARGET} as reference"
    )
    scores = corpus.run_evaluate(spark, triples, base, config, inputs_id="one").collect()
    assert len(scores) == 1 and 0 < scores[0]["BLEU"] < 100
    status = corpus.pipeline_status(spark, base, config).collect()
    assert {(r["status"], r["state"]) for r in status} == {("DONE", "OK")} and len(status) == 8
    counts = [(r["rows_in"], r["rows_clean"], r["rows_out"]) for r in status if r["stage"] == "preprocess"]
    assert counts == [(92, 91, 90)] * 2

    # The same settings with other inputs give another answer.
    exact = triples.withColumn("prediction", triples["reference"])
    again = corpus.run_evaluate(spark, exact, base, config, inputs_id="two").first()
    assert again["BLEU"] == pytest.approx(100)
    assert corpus.run_evaluate(spark, triples, base, config, inputs_id="two").first()["BLEU"] == pytest.approx(100)
    assert corpus.run_evaluate(spark, triples, base, config).first()["BLEU"] < 100  # unnamed inputs always run
    lines(tmp_path / "in.csv", *rows[:50])
    assert corpus.run_preprocess(spark, csv, base, config).count() == 50
    status = {r["stage"]: r["status"] for r in corpus.pipeline_status(spark, base, config).collect()}
    assert status["preprocess"] == "DONE" and status["eda_report"] == status["encode"] == "pending"
    words = spark.createDataFrame([("নদী", ["স্রোত"])], "token string, alternatives array<string>")
    sure = CorpusConfig(synonym_prob=1.0, swap_prob=0.0, deletion_prob=0.0)
    changed = corpus.run_augment(spark, base, words, sure, inputs_id="river").filter("is_augmented")
    assert changed.filter(f"{SOURCE} like 'স্রোত%'").count() == changed.count() > 0
    other = spark.createDataFrame([("নদী", ["ধারা"])], "token string, alternatives array<string>")
    changed = corpus.run_augment(spark, base, other, sure, inputs_id="stream").filter("is_augmented")
    assert changed.filter(f"{SOURCE} like 'ধারা%'").count() == changed.count() > 0


def story(path, name, n):
    return lines(path / f"{name}.csv", *(f"{i},{i},{name} নদী {i} বর্ষায় তীর ভাসায়,বর্ষায় নদী {i} তীর ভাসায় {name}" for i in range(n)))


def test_a_stage_built_on_a_replaced_one_is_stale(spark, tmp_path):
    """Encoding with augmented rows depends on two steps before it; neither may be of another input."""
    base = str(tmp_path / "base")
    config = CorpusConfig(use_augmented_train=True, max_input_length=8, max_target_length=8, models=(ModelSpec("m", "google/mt5-small"),))
    status = lambda: {r["stage"]: r["status"] for r in corpus.pipeline_status(spark, base, config).collect()}

    corpus.run_preprocess(spark, story(tmp_path, "a", 60), base, config)
    corpus.run_augment(spark, base, None, config)
    first = corpus.run_encode(spark, base, config).count()
    assert status() == {"preprocess": "DONE", "augmentation": "DONE", "encode": "DONE", "eda_report": "pending", "evaluate": "pending"}

    corpus.run_preprocess(spark, story(tmp_path, "b", 40), base, config)
    assert status()["preprocess"] == "DONE" and status()["augmentation"] == status()["encode"] == "pending"
    for force in (False, True):
        with pytest.raises(stages.StaleStage):
            corpus.run_encode(spark, base, config, force=force)
    with pytest.raises(stages.StaleStage):
        pair_files.split_source(spark, base, "train", True)
    assert status()["encode"] == "pending"

    train = corpus.run_augment(spark, base, None, config)
    assert train.filter(f"{SOURCE} like 'a %'").count() == 0
    second = corpus.run_encode(spark, base, config).count()
    assert second < first and status()["augmentation"] == status()["encode"] == "DONE"
    # The same preprocess run again is another run: what hangs on it is, too.
    corpus.run_preprocess(spark, str(tmp_path / "b.csv"), base, config, force=True)
    assert status()["preprocess"] == "DONE" and status()["encode"] == "pending"


@pytest.mark.parametrize("dies_at", ["write_parquet", "publish"])
def test_a_run_that_dies_leaves_the_one_before(spark, tmp_path, monkeypatch, dies_at):
    base = str(tmp_path / "base")
    config = CorpusConfig(max_input_length=8, max_target_length=8)
    corpus.run_preprocess(spark, story(tmp_path, "a", 30), base, config)
    corpus.run_eda(spark, base, config)
    before = {r["stage"]: (r["status"], r["rows_out"]) for r in corpus.pipeline_status(spark, base, config).collect()}

    class Killed(BaseException):
        pass

    calls, known = [], getattr(corpus, dies_at)

    def dying(*args, **options):
        calls.append(1)
        if len(calls) == (2 if dies_at == "write_parquet" else 1):
            raise Killed
        return known(*args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(corpus, dies_at, dying)
        with pytest.raises(Killed):
            corpus.run_preprocess(spark, story(tmp_path, "b", 50), base, config)
    assert {r["stage"]: (r["status"], r["rows_out"]) for r in corpus.pipeline_status(spark, base, config).collect()} == before
    train = pair_files.split_source(spark, base, "train")
    assert train.filter(f"{SOURCE} like 'b %'").count() == 0 < train.count()
    assert corpus.run_preprocess(spark, str(tmp_path / "b.csv"), base, config).count() == 50
    assert len(files.children(spark, f"{base}/preprocess")) == 1  # runs before are removed


def test_a_process_killed_while_it_writes(spark, tmp_path):
    """As after kill -9: a folder half written, and a record not yet put in its place."""
    base = str(tmp_path / "base")
    corpus.run_preprocess(spark, story(tmp_path, "a", 30), base)
    half = tmp_path / "base" / "preprocess" / "deadbeef0000" / "processed"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"x")
    assert pair_files.split_source(spark, base, "train").count() > 0
    # Killed between the removal of the old record and the renaming of the new one.
    record = tmp_path / "base" / "stages" / "preprocess.ok"
    record.rename(record.with_name("preprocess.ok.next-20990101"))
    assert stages.stage_record(spark, f"{base}/stages", "preprocess")["stage"] == "preprocess"
    assert corpus.run_preprocess(spark, str(tmp_path / "a.csv"), base).count() == 30  # still done
    assert {r["status"] for r in corpus.pipeline_status(spark, base).collect() if r["stage"] == "preprocess"} == {"DONE"}
    stages.mark_done(spark, f"{base}/stages", "preprocess", "again")
    assert stages.stage_record(spark, f"{base}/stages", "preprocess")["config"] == "again"
    assert not record.with_name("preprocess.ok.next-20990101").exists()


def test_malformed_rows_are_counted(spark, tmp_path):
    path = lines(tmp_path / "p.csv", "1,7,one two three,four five six", "x,8,one two four,four five seven", "3,9,one two five,four five eight")
    base = str(tmp_path / "base")
    assert corpus.run_preprocess(spark, path, base, script="[a-z]").count() == 3
    record = stages.stage_record(spark, f"{base}/stages", "preprocess")
    assert json.loads(record["metadata"])["rows"] == {"rows_in": 3, "rows_corrupt": 1, "rows_clean": 3, "rows_out": 3}


def test_single_runs_share_a_summary(spark, tmp_path):
    base = str(tmp_path)
    triples = spark.createDataFrame(
        [(m, 1, "x", p, "rain fell on the old bridge") for m, p in (("a", "rain fell on the old bridge"), ("b", "snow"))],
        "model_key string, id int, source string, prediction string, reference string",
    )
    for model in ("a", "b", "a"):
        assert [r["model_key"] for r in corpus.run_evaluate(spark, triples, base, model_key=model).collect()] == [model]
    summary = spark.read.option("header", True).csv(corpus.output(spark, base, "evaluate", "metrics/summary.csv")).collect()
    assert sorted((r["model_key"], float(r["BLEU"])) for r in summary) == [("a", pytest.approx(100)), ("b", 0.0)]


def test_stage_names_are_file_names():
    for name in ("a/b", "a b", "", "..", "ü"):
        with pytest.raises(ValueError):
            stages.stage_path("x", name)


def test_gates_stop_the_run(spark, tmp_path):
    empty = lines(tmp_path / "empty.csv")
    with pytest.raises(ValueError):
        corpus.run_preprocess(spark, empty, str(tmp_path / "a"))
    short = lines(tmp_path / "short.csv", "1,1,a,b")
    with pytest.raises(ValueError):
        corpus.run_preprocess(spark, short, str(tmp_path / "b"))
    assert not files.exists(spark, str(tmp_path / "b" / "processed"))
    with pytest.raises(FileNotFoundError):
        pair_files.split_source(spark, str(tmp_path / "b"), "train")
    with pytest.raises(FileNotFoundError):
        pair_files.split_source(spark, str(tmp_path / "b"), "train", True)
    with pytest.raises(FileNotFoundError):
        corpus.run_eda(spark, str(tmp_path / "b"))
