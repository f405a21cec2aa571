"""Summary tables that publishing needs: corpus extent, party totals and leaders, signal correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.domain import rate
from lectern.operators.members import FLOOR, HITS, rates_per_100k
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored

#: Rates closer than this count as a tie.
TIE = 0.05
BROADCAST_ROWS = 200_000


def corpus_extent(daily: DataFrame, bills: DataFrame) -> DataFrame:
    """One row: days, rows and members of the speech table, bills, and the sorted congresses and, where the rows have them, sources."""
    more = [F.array_sort(F.collect_set("source")).alias("sources")] if "source" in daily.columns else []
    speech = daily.agg(*more, F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("rows"), F.count_distinct("bioguide").alias("members"), F.array_sort(F.collect_set("congress")).alias("congresses"))
    count = bills.agg(F.count_distinct("bill_id").alias("bills"))
    return speech.withColumn("_one", F.lit(1)).join(count.withColumn("_one", F.lit(1)), "_one").drop("_one")


def party_summary(daily: DataFrame) -> DataFrame:
    """Floor totals and rates of the two major parties."""
    rows = daily.filter(F.col("chamber").isin(*FLOOR) & F.col("party").isin("D", "R"))
    return rows.groupBy("party").agg(F.count_distinct("bioguide").alias("members"), *(F.sum(c).alias(c) for c in ("words", "turns", *HITS))).select("*", *rates_per_100k())


def party_findings(daily: DataFrame, tie: float = TIE) -> DataFrame:
    """(metric, d_rate, r_rate, leader): the higher party, or 'tie' within ``tie``."""
    s = party_summary(daily)
    value = lambda p, h: F.max(F.when(F.col("party") == p, F.col(h.replace("_hits", "_per_100k"))))
    wide = s.agg(F.array(*[F.struct(F.lit(h.removesuffix("_hits")).alias("metric"), value("D", h).alias("d_rate"), value("R", h).alias("r_rate")) for h in HITS]).alias("m"))
    long = wide.select(F.inline("m"))
    gap = F.col("d_rate") - F.col("r_rate")
    return long.withColumn("leader", F.when(F.abs(gap) < tie, "tie").when(gap > 0, "D").otherwise("R"))


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of a column's distinct values: the average rank that their rows share.

    Values are counted, ranged over partitions and numbered from each partition's offset; no task holds them all.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), f"ranks-{column}")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))  # one row a partition
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    placed = ranged.withColumn("upto", upto).join(small_or_shuffled(before, BROADCAST_ROWS), "part")
    return placed.select("value", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def rank_correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, spearman) for every pair of columns over all rows, ties at their average rank; rows with a null drop out.

    The columns are stored before nulls are dropped: a filter on them would be pushed below the work that makes them and repeat it.
    """
    ranked = stored(rows.select(*columns), "ranked").dropna()
    for c in columns:
        ranks = small_or_shuffled(stored(average_ranks(ranked, c), f"rank-of-{c}"), BROADCAST_ROWS)
        ranked = ranked.join(ranks.select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}")), c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"_r_{a}", f"_r_{b}").alias("spearman")) for a, b in pairs])
    return ranked.agg(each.alias("m")).select(F.inline("m"))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of lowest SHA-256 of their key: the same rows whatever the partitioning."""
    return rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).orderBy("_h", key).limit(n).drop("_h")


def enriched(board: DataFrame, totals: DataFrame, hits: str, words: str = "words") -> DataFrame:
    """A board with each member's share of all hits and words."""
    sums = totals.agg(F.sum(hits).alias("_h"), F.sum(words).alias("_w"))
    joined = board.withColumn("_one", F.lit(1)).join(F.broadcast(sums.withColumn("_one", F.lit(1))), "_one").drop("_one")  # sums is one row
    return joined.withColumn("hit_share", rate(F.col(hits), F.col("_h"), 1)).withColumn("word_share", rate(F.col(words), F.col("_w"), 1)).drop("_h", "_w")
