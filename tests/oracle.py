"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows_of(arrow):
    names = sorted(arrow.column_names)
    return names, [arrow.schema.field(n).type for n in names], sorted(map(repr, zip(*(arrow.column(n).to_pylist() for n in names))))


def same(spark, con, sf_dir, query, sql):
    """Assert that names, types and rows agree; the number of rows."""
    left, right = rows_of(query(spark, sf_dir).toArrow()), rows_of(con.sql(sql).to_arrow_table())
    assert left[:2] == right[:2]
    different = [(a, b) for a, b in zip(left[2], right[2]) if a != b]
    assert len(left[2]) == len(right[2]) and not different, f"{len(left[2])} and {len(right[2])} rows; {different[:2]}"
    return len(left[2])
