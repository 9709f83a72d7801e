"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sql_rows(sql, sf_dir, columns):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}"
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    return sorted(repr(tuple(plain(x) for x in r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())


def spark_rows(df, columns):
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.select(*[f"`{c}`" for c in columns]).toArrow().to_pylist())
