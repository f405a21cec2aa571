"""Runs SQL with DuckDB over the Parquet tables and compares it with a Spark result, order and types aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(sf: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v).removesuffix(" 00:00:00")


def rows(frame):
    columns = sorted(frame.columns)
    floats = {c for c in columns if frame[c].dtype.kind == "f"}
    return columns, sorted(tuple(_cell(float(v)) if c in floats and v is not None else _cell(v) for c, v in zip(columns, r, strict=True)) for r in frame[columns].itertuples(index=False))


def same(frame, sf, sql):
    other = run(sf, sql)
    for c in frame.columns:
        if c in other.columns and "f" in (frame[c].dtype.kind, other[c].dtype.kind) and frame[c].dtype.kind in "fiu" and other[c].dtype.kind in "fiu":
            frame[c], other[c] = frame[c].astype(float), other[c].astype(float)
    return rows(frame) == rows(other)
