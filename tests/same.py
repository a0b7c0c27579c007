"""Comparison of a Spark result with a DuckDB one, whatever the order of rows and columns."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def value(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    return repr(float(x)) if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(value(x) for x in r) for r in df.itertuples(index=False))
