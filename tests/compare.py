"""Compare a query's rows with its SQL on the same Parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or isinstance(x, (bool, str, int)):
        return x
    if hasattr(x, "is_finite") or isinstance(x, float):
        return round(float(x), 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = views(sf_dir).sql(sql)
    return (sorted(df.columns), rows_of(df.columns, df.collect())), (sorted(rel.columns), rows_of(rel.columns, rel.fetchall()))
