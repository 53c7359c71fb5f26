"""Spark results against the same rows from DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=str)


def differences(spark, con, query, sql, sf):
    df, rel = query(spark, sf), con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(a)} and {len(b)} rows, {len(odd)} differ: {odd[:2]}" if odd or len(a) != len(b) else ""
