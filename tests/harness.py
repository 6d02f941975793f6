"""Runs queries beside their SQL check and compares whole results."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(table) -> list[tuple]:
    """Rows as text with columns by name, in one order for both engines."""
    names = sorted(table.column_names)
    columns = [[_text(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns))


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def schema_of(table) -> dict[str, str]:
    same = {"large_string": "string", "timestamp[us, tz=UTC]": "timestamptz"}
    return {
        f.name: same.get(str(f.type), str(f.type)).replace("decimal128", "decimal")
        for f in table.schema
    }


def compare(query, sql: str, spark, con, sf_dir: str) -> list[str]:
    """What differs between a query and its check; empty when equal."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.sql(sql).to_arrow_table()
    problems = []
    if schema_of(ours) != schema_of(theirs):
        mine, check = schema_of(ours), schema_of(theirs)
        problems.append(
            f"schema {dict(mine.items() - check.items())} / {dict(check.items() - mine.items())}"
        )
    if ours.num_rows != theirs.num_rows:
        problems.append(f"rows {ours.num_rows} / {theirs.num_rows}")
    elif set(ours.column_names) == set(theirs.column_names):
        a, b = canonical(ours), canonical(theirs)
        different = [(x, y) for x, y in zip(a, b) if x != y]
        if different:
            problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems
