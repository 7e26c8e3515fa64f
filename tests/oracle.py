"""Compares a query's rows with those of its SQL in DuckDB."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame, columns: list[str]) -> list:
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


def compare(query, sql: str, spark, sf: str) -> None:
    made, want = query(spark, sf), connect(sf).sql(sql).df()
    got = made.toPandas()
    whole = [c for c, kind in made.dtypes if kind in ("int", "bigint")]
    got[whole] = got[whole].astype("Int64")  # a null doesn't make them floats
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
