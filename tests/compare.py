"""Runs a query in Spark and its SQL in DuckDB and compares columns, types and rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _kind(type_name: str) -> str:
    t = type_name.lower()
    if "(" in t:
        t = t[: t.index("(")]
    return {
        "varchar": "string", "integer": "int", "hugeint": "bigint", "long": "bigint",
        "bool": "boolean",
    }.get(t, t)


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v


def rows_of(records, columns, order) -> Counter:
    index = [columns.index(c) for c in order]
    return Counter(tuple(_value(r[i]) for i in index) for r in records)


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """Number of rows and what differs."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {
        name: _kind(t)
        for name, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()
    }
    problems = []
    if sorted(sql_columns) != sorted(df.columns):
        return 0, [f"columns {sorted(df.columns)} vs {sorted(sql_columns)}"]
    for f in df.schema.fields:
        if _kind(f.dataType.simpleString()) != types[f.name]:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    order = sorted(df.columns)
    got = rows_of([tuple(r) for r in df.collect()], df.columns, order)
    want = rows_of(expected, sql_columns, order)
    if got != want:
        extra, missing = got - want, want - got
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; {order}; "
            f"only spark {list(extra)[:3]}; only sql {list(missing)[:3]}"
        )
    return sum(got.values()), problems
