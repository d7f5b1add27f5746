"""Compare a query with its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def shown(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(shown(x if not hasattr(x, "item") else x.item()) for x in r) for r in frame.itertuples(index=False))
