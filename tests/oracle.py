"""Runs a query and its SQL over one folder of tables and compares their rows."""

import decimal
import glob
import os

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows_of(frame) -> list[str]:
    names = sorted(frame.column_names)
    cells = [frame.column(n).to_pylist() for n in names]
    return sorted(repr([float(v) if isinstance(v, decimal.Decimal) else v for v in row]) for row in zip(*cells, strict=True))


def assert_same(spark, folder: str, query, sql: str) -> None:
    got, want = query(spark, folder).toArrow(), tables(folder).execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)
