"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


def _rows(rows, columns):
    return sorted((tuple(_value(r[c]) for c in columns) for r in rows), key=lambda x: tuple((v is None, str(v)) for v in x))


def assert_same(df, con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, x, strict=True)) for x in got.fetchall()]
    assert _rows([r.asDict() for r in df.collect()], sorted(names)) == _rows(want, sorted(names))
