"""Rows of a Spark query and of its SQL, made comparable."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(df, relation) -> None:
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = _sorted([tuple(_value(r[c]) for c in names) for r in df.collect()])
    at = [relation.columns.index(c) for c in names]
    theirs = _sorted([tuple(_value(r[i]) for i in at) for r in relation.fetchall()])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(y))) for x, y in zip(a, b, strict=True)), (a, b)
