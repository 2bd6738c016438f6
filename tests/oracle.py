"""Rows of a Spark query against those of DuckDB SQL."""

import decimal
import glob
import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


def same_rows(df, con, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    expected = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    found = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert found == expected
