"""Spark query vs DuckDB oracle comparison (row count, columns, values)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, sql: str, sf_dir: str) -> tuple[bool, str]:
    s = spark_df.toPandas()
    d = duck(sf_dir).sql(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} oracle={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count spark={len(s)} oracle={len(d)}"
    rs, rd = frame_rows(s), frame_rows(d)
    for i, (a, b) in enumerate(zip(rs, rd)):
        if a != b:
            cols = sorted(s.columns)
            diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return False, f"first differing row {i}: {diff[:6]}"
    return True, f"{len(s)} rows match"
