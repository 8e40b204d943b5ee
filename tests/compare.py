"""Compare a Spark result with its SQL counterpart run by DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normalised(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, floats to 6 decimals, rows sorted by all columns."""
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(6) + 0.0
    return out.sort_values(list(out.columns), key=lambda s: s.astype(str), ignore_index=True)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    found = []
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"]
    if kinds(spark_frame) != kinds(sql_frame):
        found.append(f"types {kinds(spark_frame)} and {kinds(sql_frame)}")
    if len(spark_frame) != len(sql_frame):
        return found + [f"rows {len(spark_frame)} and {len(sql_frame)}"]
    a, b = normalised(spark_frame), normalised(sql_frame)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            found.append(f"{int((~same).sum())} values of {c} differ, first {a.loc[i].to_dict()} and {b.loc[i].to_dict()}")
    return found
