"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

from __future__ import annotations

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return str(v) if not isinstance(v, int | str | bool) else v


def same(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    done = con.execute(sql)
    there = [d[0] for d in done.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(r[there.index(c)]) for c in names) for r in done.fetchall()), key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []
