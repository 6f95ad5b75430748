"""Holds a Spark result against DuckDB's on the same Parquet tables."""

import decimal
import math
import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (numbers.Number, decimal.Decimal)) or type(x).__module__ == "numpy" and not hasattr(x, "__len__"):
        return None if math.isnan(float(x)) else round(float(x), 6)
    return str(x)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=str)


def assert_same(spark_df, con, sql):
    (names, got), (wanted_names, want) = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    assert names == wanted_names
    same = got == want  # a plain value: a report on long lists takes minutes
    if not same:
        more, less = set(got) - set(want), set(want) - set(got)
        raise AssertionError(f"{len(got)} rows and {len(want)} by SQL; not in SQL {sorted(more, key=str)[:2]}, only in SQL {sorted(less, key=str)[:2]}")
