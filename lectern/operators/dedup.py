"""Row dedup and upserts with explicit precedence. Order is part of the result, never left to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored

BROADCAST_ROWS = 200_000


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. One key's rows meet in one sort, spilled if large."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def first_wins(turns: DataFrame, rank: Column, *then: Column, scope: Column | None = None) -> DataFrame:
    """Repeated turn_ids: the row of lowest source rank stays.

    ``scope`` marks the rows that take part (all by default); others pass without a shuffle.
    """
    if scope is None:
        return keep_first(turns, ["turn_id"], [rank, *then])
    inside = F.coalesce(scope, F.lit(False))
    return keep_first(turns.filter(inside), ["turn_id"], [rank, *then]).unionByName(turns.filter(~inside))


def without_repeats(rows: DataFrame, key: str, order: list[str], scope: Column | None = None) -> DataFrame:
    """As :func:`first_wins`, by finding the repeated rows on ``key`` and ``order`` alone and leaving them out.

    Wide columns are shuffled only if the repeated rows are too many to broadcast. ``order`` must tell the rows of
    one key apart and have no nulls.
    """
    slim = rows.filter(F.coalesce(scope, F.lit(False))) if scope is not None else rows
    w = Window.partitionBy(key).orderBy(*order)
    later = slim.select(key, *order).withColumn("_k", F.row_number().over(w)).filter("_k > 1").drop("_k")
    later = small_or_shuffled(stored(later.distinct(), "repeats"), BROADCAST_ROWS)
    outside = rows.filter(~F.coalesce(scope, F.lit(False))) if scope is not None else None
    kept = slim.join(later, [key, *order], "left_anti").select(*rows.columns)
    return kept if outside is None else kept.unionByName(outside)


def source_rank(path: Column) -> Column:
    """Reading order of turn files by name: bound and daily editions, bulk packages, the rest."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.startswith(name, F.lit("hein")), 0).when(F.startswith(name, F.lit("govinfo_bulk")), 1).otherwise(2)


def drop_repeated_content(turns: DataFrame, group: str, fingerprint: Column, order: list[Column]) -> DataFrame:
    """Rows of one group with equal non-empty fingerprints: the first stays. Empty fingerprints pass."""
    marked = turns.withColumn("_fp", fingerprint)
    some = keep_first(marked.filter("_fp <> ''"), [group, "_fp"], order)
    return some.unionByName(marked.filter("_fp = ''")).drop("_fp")


def prefer_unflagged(rows: DataFrame, key: str, flag: str, order: list[Column]) -> DataFrame:
    """One row a key: unflagged rows before flagged ones, then by ``order``."""
    return keep_first(rows, [key], [F.coalesce(F.col(flag), F.lit(False)).cast("int"), *order])


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Fresh rows win on ``keys``; among fresh rows of one key the last in ``order`` wins."""
    latest = keep_first(fresh, keys, [c.desc() for c in order]) if order else fresh
    return stored.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def replace_groups(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All stored rows of a key that fresh rows have are replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def changed_records(listed: DataFrame, known: DataFrame, key: str, fields: list[str], newer: Column | None = None) -> DataFrame:
    """Listed records that are unknown, or differ in ``fields``, or are newer. ``known`` columns: key and k_<field>."""
    joined = listed.join(known, key, "left")
    differs = F.coalesce(F.col(f"k_{fields[0]}"), F.lit("")) != F.coalesce(F.col(fields[0]), F.lit(""))
    for f in fields[1:]:
        differs = differs | (F.coalesce(F.col(f"k_{f}"), F.lit("")) != F.coalesce(F.col(f), F.lit("")))
    unknown = F.col("k_known").isNull()
    return joined.filter(unknown | differs | (newer if newer is not None else F.lit(False))).select(*listed.columns)
