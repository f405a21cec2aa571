"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: its target share of all characters over its present share. A document's
count inverts the Poisson distribution of that rate at a uniform number hashed from seed and doc_id, so the
counts need no coordination and repeat exactly. Documents are exploded by their count, and the copies are
shuffled globally by a hashed key, which also orders each output partition.

Without given weights the target of a source is its characters to the power ``TEMPERATURE`` (small sources
rise, large ones fall). With given weights, sources without one are left out. Null is a source of its own.
A source without characters keeps rate 1. A null doc_id hashes its text instead; rows that repeat a doc_id get
the same count. An empty input gives an empty result. Columns ``mix_replica`` and ``mix_key`` are added, or
replaced if the documents have such. No rate is capped: up to ``TABLE_RATE`` the distribution is a table per
source, above it each document walks the part of the distribution that 52 bits can tell, from a first value
taken in log space, and copies are made in blocks. ``mix_replica`` is an int, so one document can have 2^31 - 1 copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored

SEED = "mix-1"
TEMPERATURE = 0.5
#: Up to here exp(-rate) stays well above the smallest double, and tables stay short.
TABLE_RATE = 500.0
COPY_BLOCK = 10_000
BROADCAST_ROWS = 100_000


def uniform(key: Column) -> Column:
    """[0, 1) from the first 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Values of the distribution function at 0, 1, 2, ... as far as 52 bits can tell."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["steps"], F.element_at(acc["steps"], -1) + p).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def poisson_walk(rate: Column, u: Column) -> Column:
    """Number of values of the distribution function up to ``u``, for rates above TABLE_RATE."""
    reach = 12 * F.sqrt(rate) + 20
    first, last = F.floor(rate - reach).cast("long"), F.ceil(rate + reach).cast("long")
    # ln(rate^k exp(-rate) / k!) with Stirling's series, written so that large terms cancel before they are rounded
    log_p = first - rate + first * F.log(rate / first) - F.log(2 * math.pi * first) / 2 - 1 / (12.0 * first) + 1 / (360.0 * F.pow(first.cast("double"), F.lit(3.0)))
    p = F.exp(log_p)
    start = F.struct(p.alias("p"), p.alias("upto"), (first + F.when(p <= u, 1).otherwise(0)).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        upto = acc["upto"] + p
        return F.struct(p.alias("p"), upto.alias("upto"), (acc["n"] + F.when(upto <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["n"])


def repetition_rates(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate) over all documents."""
    sizes = documents.select(F.col("source").cast("string").alias("source"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("size"))
    if weights is None:
        target = F.pow("size", F.lit(TEMPERATURE))
    else:
        given = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        target = F.coalesce(*given, F.lit(0.0))
    sizes = stored(sizes.withColumn("target", target), "mixing-sizes")
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum("target").alias("all_target"))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.col("target") / F.col("all_target") * F.col("all_size") / F.col("size"))
    first = whole.first()
    return sizes.withColumn("all_size", F.lit(first["all_size"])).withColumn("all_target", F.lit(first["all_target"])).select("source", rate.alias("rate"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """Every document as often as its count says, in a global random order."""
    documents = documents.drop("mix_replica", "mix_key")
    steps = F.when(F.col("rate") <= TABLE_RATE, poisson_steps(F.col("rate")))
    rates = repetition_rates(documents, weights).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"), steps.alias("_mix_steps"))
    rates = small_or_shuffled(stored(rates, "mixing-rates"), BROADCAST_ROWS)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    joined = documents.join(rates, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")))
    counted = joined.withColumn("_mix_name", name).withColumn("_mix_u", uniform(F.col("_mix_name")))
    in_table = F.size(F.filter("_mix_steps", lambda c: c <= F.col("_mix_u"))).cast("long")
    copies = F.when(F.col("_mix_steps").isNotNull(), in_table).otherwise(poisson_walk(F.col("_mix_rate"), F.col("_mix_u")))
    blocks = counted.withColumn("_mix_n", copies.cast("int")).filter("_mix_n > 0").withColumn("_mix_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n").cast("long"), F.lit(COPY_BLOCK).cast("long"))))
    upto = F.least(F.col("_mix_n"), F.col("_mix_from") + (COPY_BLOCK - 1)).cast("int")
    exploded = blocks.withColumn("mix_replica", F.explode(F.sequence(F.col("_mix_from").cast("int"), upto)))
    keyed = exploded.withColumn("mix_key", F.substring(F.sha2(F.concat_ws(":", "_mix_name", "mix_replica"), 256), 1, 16))
    return keyed.select(*documents.columns, "mix_replica", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE power(size, 0.5) / (SELECT sum(power(size, 0.5)) FROM s) * (SELECT sum(size) FROM s) / size END AS rate FROM s),
c AS (SELECT source, list_transform(range(0, 120), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate) * power(rate, j) / gamma(j + 1)))) AS steps FROM r),
d AS (SELECT d.*, 'mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, '')) AS nm, steps FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT *, len(list_filter(steps, lambda x: x <= ('0x' || substr(sha256(nm), 1, 13))::BIGINT / 4503599627370496.0)) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, mix_replica::INTEGER AS mix_replica, substr(sha256(nm || ':' || mix_replica::VARCHAR), 1, 16) AS mix_key
FROM n, unnest(range(1, n + 1)) t(mix_replica)
"""
