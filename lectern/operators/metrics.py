"""Word-weighted rate tables from scored turns, and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.domain import blank_to_null, rate, year_of_congress
from lectern.functions.scoring import SCORES


@dataclass(frozen=True)
class Metric:
    """One rate: its raw count, the score it sums, and what it is divided by."""

    rate: str
    raw: str
    score: str
    base: str = "words"
    scale: int = 1000
    headline: bool = False
    by_chamber: bool = False

    def __post_init__(self):
        if self.scale <= 0 or self.score not in SCORES:
            raise ValueError(f"bad metric {self}")


HEADLINE = ("formal_courtesy", "gratitude_praise", "cooperation", "hostility", "misconduct", "profanity")
_SHORT = {"outgroup_refs": "outgroup_ref_per_1k"}


def _metric(score: str) -> Metric:
    if score.endswith("_contexts"):
        return Metric(f"{score}_per_100_refs", score, score, "outgroup_refs", 100)
    stem = score.removesuffix("_hits")
    raw = f"{score}_hits" if score in ("profanity_mild", "profanity_strong", "profanity_slurs") else score
    return Metric(_SHORT.get(score, f"{stem}_per_1k"), raw, score, headline=stem in HEADLINE, by_chamber=stem in HEADLINE and stem != "gratitude_praise")


METRICS = tuple(map(_metric, SCORES))
GROUP = ("source", "congress", "chamber", "party")


def with_groups(turns: DataFrame) -> DataFrame:
    """Group keys with blanks filled: unknown source, other chamber and party."""
    fill = {"source": "unknown", "chamber": "other", "party": "other"}
    return turns.withColumns({k: F.coalesce(blank_to_null(F.col(k)), F.lit(v)) for k, v in fill.items()})


def substantive(turns: DataFrame) -> DataFrame:
    return turns.filter(~F.coalesce("is_procedural", F.lit(False)))


def sum_scores(scored: DataFrame, keys=GROUP, sentiment: bool = False) -> DataFrame:
    """Turns, words and the sum of every score by ``keys``; partial sums of a state table add up the same way."""
    sums = [F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"), *(F.sum(s).alias(s) for s in SCORES)]
    if sentiment:
        weight = F.coalesce("n_sentences", F.lit(0))
        sums += [F.sum(F.col(c) * weight).alias(f"{c}_sum") for c in ("sentiment", "neg_share")] + [F.sum(weight).alias("sentiment_n")]
    return scored.groupBy(*keys).agg(*sums)


def merge_sums(partials: DataFrame, keys=GROUP) -> DataFrame:
    more = [c for c in ("sentiment_sum", "neg_share_sum", "sentiment_n") if c in partials.columns]
    return partials.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("turns", "words", *SCORES, *more)))


def rates(metrics=METRICS) -> list[Column]:
    return [rate(F.col(m.raw), F.col(m.base), m.scale).alias(m.rate) for m in metrics]


def metric_table(sums: DataFrame, metrics=METRICS) -> DataFrame:
    """By source: keys, year, turns, words, raw counts and rates in registry order, and sentiment means if ``sums`` has them."""
    means = sentiment_means() if "sentiment_n" in sums.columns else []
    raw = sums.select("source", "congress", year_of_congress(F.col("congress")).alias("year"), "chamber", "party", "turns", "words", *(F.col(m.score).alias(m.raw) for m in metrics), *means)
    last = ["mean_sentiment", "mean_neg_share"] if means else []
    return raw.select(*[c for c in raw.columns if c not in last], *rates(metrics), *last)


def sentiment_means() -> list[Column]:
    """Sentence-weighted means; null without sentences."""
    return [F.try_divide(f"{c}_sum", "sentiment_n").alias(f"mean_{c}") for c in ("sentiment", "neg_share")]


def coverage(turns: DataFrame) -> DataFrame:
    """Turn and word counts by source, congress and chamber before the procedural filter, and party shares."""
    words, procedural = F.coalesce("word_count", F.lit(0)), F.coalesce("is_procedural", F.lit(False))
    classes = {
        "total": F.lit(True), "procedural": procedural, "nonprocedural": ~procedural,
        "analysis_party": ~procedural & F.coalesce(F.col("party").isin("D", "R", "I"), F.lit(False)),
    }
    known = turns.withColumn("_party", F.col("party"))
    sums = [f for k, c in classes.items() for f in (F.count_if(c).alias(f"{k}_turns"), F.sum(F.when(c, words).otherwise(0)).alias(f"{k}_words"))]
    table = with_groups(known).groupBy("source", "congress", "chamber").agg(*sums)
    return table.select(
        "source", "congress", year_of_congress(F.col("congress")).alias("year"), "chamber", *[f"{k}_{u}" for k in classes for u in ("turns", "words")],
        rate(F.col("analysis_party_turns"), F.col("nonprocedural_turns"), 1).alias("party_turn_share"),
        rate(F.col("analysis_party_words"), F.col("nonprocedural_words"), 1).alias("party_word_share"),
    )


# The bound and daily editions lead through this congress, the other source after it.
PRIMARY_LAST_CONGRESS, PRIMARY_EARLY, PRIMARY_LATE = 114, "hein", "govinfo"


def primary_source(table: DataFrame) -> DataFrame:
    """One row a congress, chamber and party: from the source that leads in that congress."""
    early = F.col("congress") <= PRIMARY_LAST_CONGRESS
    leads = F.when(early, F.startswith("source", F.lit(PRIMARY_EARLY))).otherwise(F.col("source") == PRIMARY_LATE)
    order = Window.partitionBy("congress", "chamber", "party").orderBy(F.when(leads, 0).otherwise(1), "source")
    return table.filter(leads).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def primary_boundary_year(table: DataFrame) -> DataFrame:
    """One row: the first year in which the later source leads; null if it has none."""
    late = (F.col("source") == PRIMARY_LATE) & (F.col("congress") > PRIMARY_LAST_CONGRESS)
    return table.agg(F.min(F.when(late, F.col("year"))).alias("primary_boundary_year"))


def source_ranges(table: DataFrame) -> DataFrame:
    return table.groupBy("source").agg(
        F.min("congress").alias("min_congress"), F.max("congress").alias("max_congress"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count(F.lit(1)).alias("rows"),
    )
