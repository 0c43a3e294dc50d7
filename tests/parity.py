"""Rows of a Spark query and of its SQL in DuckDB in one comparable form."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, str | bytes):
        return x
    if hasattr(x, "__len__"):
        return [plain(y) for y in x]
    return float(x) if not hasattr(x, "isoformat") else str(x)


def rows(frame: pd.DataFrame) -> list[str]:
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(plain(x) for x in r)) for r in ordered.itertuples(index=False))


def same(spark_frame, db, sql: str) -> None:
    ours, theirs = spark_frame.toPandas(), db.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
