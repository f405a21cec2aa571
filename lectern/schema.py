"""Fixed schemas of the two canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
TURN = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("turn_id", _S), ("source", _S), ("date", _S), ("congress", T.IntegerType()), ("chamber", _S), ("speaker_name", _S), ("speaker_id", _S),
        ("bioguide", _S), ("party", _S), ("state", _S), ("word_count", _L), ("is_procedural", T.BooleanType()), ("text", _S),
    )]
)
MEMBERS = "array<struct<party:string,bioguide:string,name:string,state:string>>"


def conform(rows: DataFrame, schema: T.StructType = TURN) -> DataFrame:
    """Exactly the schema's columns: extra ones drop, absent ones are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
