"""Runs a registered query and its DuckDB twin and compares names, types and values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(dtype: str) -> str:
    d = dtype.lower()
    if d in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "int"
    if d in ("float", "double") or d.startswith("decimal"):
        return "float"
    if d.startswith("timestamp"):
        return "ts"
    if d in ("string", "varchar"):
        return "str"
    return d


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        return int(v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark_df, con, sql: str) -> tuple[str | None, int]:
    """(what differs or None, rows of the Spark result)."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    ours = dict(spark_df.dtypes)
    got = spark_df.toPandas()
    if set(ours) != set(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}", len(got)
    for c in ours:
        if _kind(ours[c]) != _kind(theirs[c]):
            return f"type of {c}: {ours[c]} != {theirs[c]}", len(got)
    want = rel.df()
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(got)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(ours)}: {x} != {y}", len(got)
    return None, len(got)
