"""Comparison of a Spark result with a DuckDB result, row by row and independent of order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def sql_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        files = f / "*.parquet" if f.is_dir() else f
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def as_bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DATE": "date", "VARCHAR": "string", "DOUBLE": "double"}


def assert_same(result, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(result.columns) == sorted(names)
    expected = as_bag(names, answer.fetchall())
    actual = as_bag(result.columns, result.collect())
    assert actual.total() == expected.total()
    assert not (actual - expected), list((actual - expected).items())[:5]
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert dict(result.dtypes) == {c: SQL_TYPES[t] for c, t in types.items()}
