"""Compare queries with their SQL: the same rows whatever their order, columns by name."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for c in got.columns:
        kinds = {"i": "i", "u": "i", "f": "f", "b": "b", "O": "O", "M": "M"}
        a, b = kinds.get(got[c].dtype.kind), kinds.get(want[c].dtype.kind)
        if a != b and not {a, b} <= {"f", "i", "O"}:
            return f"{c}: {got[c].dtype} and {want[c].dtype}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        off = a[c].fillna("null") != b[c].fillna("null")
        if off.any():
            i = off.idxmax()
            return f"{off.sum()} values of {c}, first {a.loc[i].to_dict()} and {b.loc[i].to_dict()}"
    return ""
