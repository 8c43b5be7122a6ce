"""Holds a query against its SQL in DuckDB, regardless of the order of rows and columns."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def rows(p: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, list | np.ndarray):
            return str(list(v))
        if pd.isna(v):
            return "null"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        if isinstance(v, int | float | np.number):
            return str(round(float(v), 5) + 0.0)
        return str(v)

    return sorted(tuple(map(plain, r)) for r in p[sorted(p.columns)].astype(object).itertuples(index=False))


def same(spark, con, folder, query, sql) -> None:
    ours, theirs = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
