"""Holds a query's rows against those of its SQL."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, list | tuple) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    return tuple((k, plain(x)) for k, x in v.items()) if isinstance(v, dict) else v


def check(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(repr(plain(r)) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
