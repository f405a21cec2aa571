"""Paired cells of two sources and what they say about a multiplicative adjustment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.domain import rate, source_family
from lectern.operators.metrics import METRICS

# Fixed values of the stability rule.
MIN_PAIRS, MIN_SPEARMAN, MAX_LOG_IQR = 20, 0.70, math.log(1.5)
KEYS = ["congress", "year", "chamber", "party"]


def family_table(table: DataFrame, metrics=METRICS) -> DataFrame:
    """Raw counts summed by source family and cell, floor chambers and major parties only."""
    rows = table.filter(F.col("chamber").isin("house", "senate") & F.col("party").isin("D", "R"))
    raw = sorted({m.raw for m in metrics} | {"words", "outgroup_refs"})
    return rows.groupBy(source_family(F.col("source")).alias("source_family"), *KEYS).agg(*(F.sum(c).alias(c) for c in raw))


def unpivot_rates(table: DataFrame, metrics=METRICS) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m.rate).alias("metric"), rate(F.col(m.raw), F.col(m.base), m.scale).alias("rate")) for m in metrics])
    return table.select("source_family", *KEYS, F.inline(each))


def paired(long: DataFrame, left: str = "hein", right: str = "govinfo") -> DataFrame:
    """Cells that both families have: their rates, difference and ratio (null where the right one is 0)."""
    wide = long.groupBy(*KEYS, "metric").pivot("source_family", [left, right]).agg(F.first("rate"))
    wide = wide.dropna(subset=[left, right])
    return wide.select(
        *KEYS, "metric", F.col(left).alias(left), F.col(right).alias(right), (F.col(right) - F.col(left)).alias(f"difference_{right}_minus_{left}"),
        F.when(F.col(right) > 0, F.try_divide(left, right)).alias(f"ratio_{left}_to_{right}"),
    )


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank in which ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def summary(pairs: DataFrame, left: str = "hein", right: str = "govinfo", keys=("metric",)) -> DataFrame:
    """Agreement of the paired cells by metric, and the multiplier where it is stable."""
    keys = list(keys)
    ranked = pairs.withColumn("_rl", average_rank(left, keys)).withColumn("_rr", average_rank(right, keys))
    both = (F.col(left) > 0) & (F.col(right) > 0)
    log_ratio = F.when(both, F.ln(F.try_divide(left, right)))
    varied = (F.col("_nl") > 1) & (F.col("_nr") > 1)
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paired_cells"), F.count_if(both).alias("positive_paired_cells"),
        F.count_distinct(left).alias("_nl"), F.count_distinct(right).alias("_nr"),
        F.corr(left, right).alias("_pearson"), F.corr("_rl", "_rr").alias("_spearman"),
        F.avg(F.col(right) - F.col(left)).alias("mean_difference"), F.percentile(log_ratio, [0.25, 0.5, 0.75]).alias("_q"),
    )
    out = out.withColumn("pearson", F.when(varied, F.col("_pearson"))).withColumn("spearman", F.when(varied, F.col("_spearman")))
    out = out.withColumn("multiplier", F.exp(F.get("_q", F.lit(1)))).withColumn("log_ratio_iqr", F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)))
    stable = (F.col("paired_cells") >= MIN_PAIRS) & (F.col("spearman") >= MIN_SPEARMAN) & (F.col("log_ratio_iqr") <= MAX_LOG_IQR)
    out = out.withColumn("stable", F.coalesce(stable, F.lit(False)))
    out = out.withColumn("recommended_multiplier", F.when(F.col("stable"), F.col("multiplier")))
    return out.select(*keys, "paired_cells", "positive_paired_cells", "pearson", "spearman", "mean_difference", "multiplier", "log_ratio_iqr", "stable", "recommended_multiplier")


def calibrated(long: DataFrame, multipliers: DataFrame, boundary_year: int) -> DataFrame:
    """``rate`` from the boundary year on times its metric's multiplier; null there without a stable one."""
    joined = long.join(multipliers.select("metric", "recommended_multiplier"), "metric", "left")
    adjusted = F.when(F.col("year") >= boundary_year, F.col("rate") * F.col("recommended_multiplier")).otherwise(F.col("rate"))
    return joined.select(*long.columns, adjusted.alias("calibrated_rate"))
