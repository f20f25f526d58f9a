"""Compare a query with its SQL twin on DuckDB, rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(df, sql, con):
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((tuple(plain(x[names.index(c)]) for c in order) for x in out.fetchall()), key=str)
    ours = sorted((tuple(plain(x[c]) for c in order) for x in df.collect()), key=str)
    assert ours == theirs
