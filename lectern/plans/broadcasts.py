"""Broadcast a join side only after its rows and bytes have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of values that one broadcast side may have.
MAX_BYTES = 64 << 20


def _width(field: T.StructField):
    """Bytes of a value: 8 for numbers, the text's bytes for all else."""
    fixed = isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
    value = F.col(f"`{field.name}`")
    if fixed:
        return F.lit(8)
    flat = value if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(value))
    return F.coalesce(F.octet_length(flat), F.lit(0)) + 8


def row_bytes(df: DataFrame):
    """Bytes of a row's values."""
    return sum((_width(f) for f in df.schema), F.lit(0)).cast("long")


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of ``max_bytes`` in all; both are counted. Give it stored tables."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def small_or_shuffled(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of ``max_bytes`` in all, else ``df`` as it is.

    Without the hint Spark plans a shuffle join, which adaptive execution splits where a key is hot.
    Give it stored tables: what is not stored is computed once to be counted and again in the join.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
