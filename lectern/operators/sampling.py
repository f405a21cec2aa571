"""Deterministic stratified samples: the k rows of lowest hash priority in each stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.domain import era_of, hash_priority, passage, source_family, year_of_congress
from lectern.functions.scoring import Scorer, score_turns
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored

VERSION = "sample-v1"
BROADCAST_ROWS = 100_000
SIGNAL_SCORE = {
    "formal_courtesy": "formal_courtesy_hits", "gratitude_praise": "gratitude_praise_hits", "cooperation": "cooperation_hits",
    "personal_attack": "hostility_hits", "misconduct_allegation": "misconduct_hits", "profanity": "profanity_hits",
    "identity_slur": "profanity_slurs", "outparty_target": "outgroup_refs",
}


def bottom_k(rows: DataFrame, stratum: str, priority: Column, tie: Column, quota: Column | int) -> DataFrame:
    """Rows of lowest priority per stratum, ties by descending ``tie``.

    With a literal quota Spark cuts each task's strata to it before the shuffle; give slim rows otherwise.
    """
    w = Window.partitionBy(stratum).orderBy(priority, tie.desc())
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= quota)


def year_of_turn(date: Column, congress: Column) -> Column:
    """The date's year, else the first year of the congress."""
    return F.coalesce(F.when(F.substring(date, 1, 4).rlike(r"\A\d{4}\z"), F.substring(date, 1, 4).try_cast("int")), year_of_congress(congress))


def validation_sample(turns: DataFrame, scorer: Scorer, signal_quota: int, random_quota: int, chars: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(blinded rows, hidden scores): passages around a signal or a hashed place, by era, family, chamber and party.

    A turn can be in several strata; turn_ids must be unique. The draw is of (turn_id, stratum, priority) alone, cut
    to the quotas before it is shuffled; texts are joined to what was drawn. Hidden scores are those of the passage.
    """
    rows = turns.filter(F.col("chamber").isin("house", "senate") & F.col("party").isin("D", "R"))
    year = year_of_turn(F.coalesce("date", F.lit("")), F.col("congress"))
    rows = rows.withColumn("year", year).withColumn("era", era_of(year)).withColumn("source_family", source_family(F.col("source")))
    rows = rows.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("base", F.concat_ws("|", "era", "source_family", "chamber", "party"))
    none = F.array().cast("array<struct<st:int,en:int>>")
    signals = scorer.signal_spans(F.col("low"), F.col("party"))
    some = F.col("low").rlike(scorer.any_signal())
    kinds = [F.lit("random"), F.when(F.coalesce("is_procedural", F.lit(False)), F.lit("procedural"))]
    kinds += [F.when(some & (F.size(spans) > 0), F.lit(name)) for name, spans in signals.items()]
    strata = rows.select("turn_id", "base", F.explode(F.array_compact(F.array(*kinds))).alias("kind")).withColumn("stratum", F.concat_ws("|", "base", "kind"))
    strata = strata.select("turn_id", "kind", "stratum", hash_priority(F.lit(VERSION), F.col("stratum"), F.col("turn_id")).alias("priority"))
    quota = F.when(F.col("kind").isin("random", "procedural"), random_quota).otherwise(signal_quota)
    drawn = bottom_k(strata, "stratum", F.col("priority"), F.col("turn_id"), max(signal_quota, random_quota)).filter(F.col("k") <= quota)
    drawn = small_or_shuffled(stored(drawn.drop("k"), "sample-drawn"), BROADCAST_ROWS)

    taken = rows.join(drawn, "turn_id")
    spans = F.coalesce(*[F.when(F.col("kind") == name, s) for name, s in signals.items()], none)
    taken = taken.withColumn("spans", spans)
    size = F.size("spans")
    at = F.when(size > 0, F.get("spans", (F.col("priority") % F.greatest(size, F.lit(1))).cast("int"))["st"]).otherwise(
        (F.col("priority") % F.greatest(F.length("low"), F.lit(1))).cast("int")
    )
    taken = taken.withColumn("passage", passage(F.coalesce("text", F.lit("")), at, chars)).withColumn("passage_sha256", F.sha2("passage", 256))
    taken = taken.withColumn("sample_id", F.concat(F.lit("VAL-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "turn_id", "stratum", "passage_sha256"), 256), 1, 20))))
    shown = ["turn_id", "source", "source_family", "date", "congress", "year", "era", "chamber", "speaker_name", "party", "passage", "passage_sha256", "sample_id"]
    hidden = score_turns(taken.select("sample_id", "turn_id", "passage_sha256", F.col("stratum").alias("sampling_stratum"), "party", "passage"), scorer, text="passage")
    return taken.select(*shown), hidden.drop("passage", "party")


def slices(rows: DataFrame, order: str, size: int = 50) -> DataFrame:
    """Stable batches of ``size`` rows by ``order``, numbered from 0.

    Numbers come from per-range counts: the rows are ranged by ``order``, counted in each partition, and
    numbered from the partition's offset, so no task holds all rows.
    """
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged, "slices")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    numbered = ranged.join(small_or_shuffled(before, BROADCAST_ROWS), "_p").withColumn("_k", F.col("_before") + local - 1)
    return numbered.withColumn("batch", F.floor(F.col("_k") / size)).drop("_p", "_before", "_k")
