"""Run registered queries in Spark and their SQL in DuckDB, and compare values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    listed = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(listed, key=lambda r: tuple((v is not None, v or "") for v in r))


def difference(spark_df, connection, sql: str) -> str | None:
    """What differs, or None."""
    left_columns, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    right_columns, right = rows_of([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} and {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows, first {wrong[0]}" if wrong else None


def main(names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from twinline.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, connection = local_session(8), database(sf_dir)
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            sql = oracle_sql().get(name)
            wrong = difference(df, connection, sql) if sql else f"(no SQL, {df.count()} rows)"
        except Exception as error:  # report and go on to the next query
            wrong = f"{type(error).__name__}: {str(error).splitlines()[0][:600]}"
        bad += wrong is not None and not wrong.startswith("(no SQL")
        print(f"{name:24s} {time.time() - start:6.1f}s  {wrong or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
