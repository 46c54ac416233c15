"""Rows of a query and of its SQL, comparable."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def rows_of_sql(sql, sf_dir=None, **tables):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES if sf_dir else ():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, arrow in tables.items():
        con.register(name, arrow)
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return cols, sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
