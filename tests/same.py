"""A query's rows against its SQL in DuckDB."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(repr(v) for v in row) for row in frame.select(*columns).collect()), key=str), columns


def same(query, sql, spark, sf_dir=SF):
    ours, columns = rows_of(query(spark, sf_dir))
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    made = con.sql(sql)
    assert sorted(made.columns) == columns
    theirs = sorted((tuple(repr(v) for v in row) for row in made.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=str)
    assert ours == theirs
