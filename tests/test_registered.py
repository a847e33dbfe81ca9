"""Every registered query against its SQL, and what its plan must not hold."""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import database, difference
from twinline.registry.oracles import ORACLES
from twinline.registry.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

NO_SQL: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test data at {SF_DIR}")
    return database(SF_DIR)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, connection, sql) is None


def test_entry(spark, connection):
    row = entry(spark).first()
    assert row["total_rows"] > 0 and row["source_sentence_nulls"] == 0


def test_queries_are_there_without_the_libraries_of_the_other_part():
    """The operators for training data may be taken out, or lack a library: all other queries stay."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['regex'] = sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert told.split() == [str(len(QUERIES)), str(len(ORACLES))]
