"""Run a query's SQL in DuckDB and compare its rows with Spark's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).df()


def plain(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(str(x) for x in row) for row in frame[cols].itertuples(index=False))


def same(spark_frame, sql_frame):
    a, b = plain(spark_frame), plain(sql_frame)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not wrong, wrong[:3]
