"""Run a query in Spark and its SQL in DuckDB, and compare the rows whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows(table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*[map(plain, table[n].to_pylist()) for n in names], strict=True)))


def compare(spark_table, sql_table) -> None:
    assert sorted(spark_table.column_names) == sorted(sql_table.column_names)
    a, b = rows(spark_table), rows(sql_table)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []
