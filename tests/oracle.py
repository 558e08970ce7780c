"""Compares a Spark result with DuckDB's, whatever the order of rows and columns."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else x.normalize()
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def compare(df, con, sql):
    out = con.sql(sql)
    names = sorted(out.columns)
    assert sorted(df.columns) == names
    want = sorted((tuple(plain(dict(zip(out.columns, r, strict=True))[n]) for n in names) for r in out.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
