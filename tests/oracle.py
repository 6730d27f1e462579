"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)


def expected(sql, cols):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.sql(sql).columns) == cols
    return sorted((tuple(_plain(x) for x in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), key=repr)
