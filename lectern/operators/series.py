"""Time series, rollup levels and the party asymmetry pivot. Rates are made after summing, never averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.members import COUNTS, FLOOR, HITS, in_congress, rates_per_100k


def period(date: Column, monthly: bool) -> Column:
    return F.date_format(F.try_to_date(date), "yyyy-MM" if monthly else "yyyy")


def chamber_series(daily: DataFrame, monthly: bool = False) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("words", "profanity_hits", "turns")]
    return daily.groupBy(period(F.col("date"), monthly).alias("period"), "chamber").agg(*sums).select("*", *rates_per_100k(("profanity_hits",)))


def language_series(daily: DataFrame, congress: int | None = None, by_chamber: bool = False) -> DataFrame:
    """By year over all congresses, by month within one. Days that are no dates drop out."""
    rows = in_congress(daily, congress).filter(F.col("chamber").isin(*FLOOR) & F.col("party").isin("D", "R"))
    rows = rows.withColumn("period", period(F.col("date"), congress is not None)).filter("period IS NOT NULL")
    keys = ["period", "party", *(["chamber"] if by_chamber else [])]
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("words", "turns", *HITS))).select("*", *rates_per_100k())


def rollup_levels(table: DataFrame, sets: list[list[str]], sums: list[str]) -> DataFrame:
    """Several grouping levels in one pass; ``level`` numbers the grouping set, keys outside it are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = table.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().cast("long").alias("level"), *(F.sum(c).alias(c) for c in sums))
    return out.select(*keys, "level", *sums)


def party_gap(table: DataFrame, value: str, keys: list[str], parties=("D", "R")) -> DataFrame:
    """Mean of ``value`` by party, side by side, and the first party's less the second's where both are there."""
    wide = table.groupBy(*keys).pivot("party", list(parties)).agg(F.avg(value)).dropna(subset=list(parties))
    return wide.withColumn("gap", F.col(parties[0]) - F.col(parties[1]))


def chamber_mean_gap(table: DataFrame, value: str, keys: list[str], parties=("D", "R"), chambers=FLOOR) -> DataFrame:
    """The party gap of each chamber side by side and their mean with equal weights, where all chambers have one."""
    gaps = party_gap(table, value, [*keys, "chamber"], parties)
    wide = gaps.groupBy(*keys).pivot("chamber", list(chambers)).agg(F.max("gap")).dropna(subset=list(chambers))
    return wide.withColumn("gap", sum((F.col(c) for c in chambers), F.lit(0.0)) / len(chambers))


def centred_mean(rows: DataFrame, value: str, order: str, keys: list[str], reach: int = 2, at_least: int = 3) -> DataFrame:
    """Mean over ``reach`` rows either side; null below ``at_least`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn(f"{value}_smooth", F.when(F.count(value).over(w) >= at_least, F.avg(value).over(w)))


__all__ = ["COUNTS", "centred_mean", "chamber_mean_gap", "chamber_series", "language_series", "party_gap", "period", "rollup_levels"]
