"""The registered queries and the pipeline, on the smallest tables."""

import hashlib
import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.compare import database, difference
from twinline.llm.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
NATIVE = ("op1_url_filters", "op2_sharding")


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test data at {SF_DIR}")
    return database(SF_DIR)


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BatchEvalPython", *(("Python", "Arrow") if name in NATIVE else ())):
        assert unwanted not in plan
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, connection, sql) is None


def test_whole_tables_are_answered(spark, connection):
    for name, table in (("op1_url_filters", "pages"), ("op2_sharding", "documents"), ("op6_html_extraction", "pages"), ("op4_toxicity", "documents")):
        rows = connection.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
        assert queries()[name](spark, SF_DIR).count() == rows


def test_stages_against_plain_python(spark):
    """Each stage by itself, on documents whose fate is known."""
    text = lambda n, k=120: " ".join(f"w{n}x{i}" for i in range(k))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (1, text(1)), (2, text(1)), (3, text(1) + " more"), (4, text(4)), (5, text(5) + " " + item + " " + text(6)),
        (6, "short"), (7, None), (8, text(7, 30) + " " + text(4, 40) + " " + text(8, 30)), (9, ""), (None, text(1)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: {r.doc_id: r for r in stages[name](spark, docs, SF_DIR).collect()}

    assert set(kept("toxicity")) == {i for i, _ in rows}  # none is toxic
    assert set(kept("ngram_jaccard_join")) == {1, 4, 5, 6, 7, 8, 9, None}
    assert set(kept("benchmark_decontamination")) == {i for i, _ in rows} - {5}

    cut = kept("suffix_array_dedup")
    assert set(cut) == {1, 3, 4, 5, 6, 7, 8, 9, None}  # 2 is all repeated
    seen, want = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        body = (t or "").encode()
        gone = set()
        for at in range(len(body) - 99):
            if body[at : at + 100] in seen:
                gone.update(range(at, at + 100))
            seen.add(body[at : at + 100])
        want[i] = None if t is None else bytes(b for at, b in enumerate(body) if at not in gone).decode()
    assert all(cut[i].text == t for i, t in want.items() if i != 2)
    assert all(r.n_chars == len(r.text or "") for r in cut.values())

    coded = kept("bpe")
    assert all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if (r := coded[i]))


def test_stages_tell_rows_apart_that_share_an_id(spark):
    """Two texts under one id, equal rows, and rows without an id."""
    text = lambda n, k=120: " ".join(f"w{n}x{i}" for i in range(k))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak = text(9) + " " + item
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(3)), (None, leak), (None, text(4)), (3, leak), (3, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, SF_DIR).collect()), key=str)
    assert kept("ngram_jaccard_join") == sorted({r for r in rows if r[0] is not None} | {(None, leak), (None, text(4))}, key=str)
    assert kept("benchmark_decontamination") == sorted([r for r in rows if item not in r[1]], key=str)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_pipeline(spark):
    rows = queries()["pipeline"](spark, SF_DIR)
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids))
