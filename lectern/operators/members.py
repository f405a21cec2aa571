"""Member-day counts, latest attributes, activity and ranked boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.domain import blank_to_null, rate
from lectern.functions.scoring import Scorer, score_turns
from lectern.functions.text import mask_quotes, tokens

FLOOR = ("house", "senate")
HITS = ("profanity_hits", "hostility_hits", "misconduct_hits")
COUNTS = ("turns", "words", "profanity_hits", "profanity_quoted_hits", "hostility_hits", "misconduct_hits")
PER = 100_000
MIN_WORDS, TOP = 25_000, 25


def attributed(turns: DataFrame) -> DataFrame:
    """Turns of known members on known days that are not procedural."""
    day = F.substring(F.coalesce("date", F.lit("")), 1, 10)
    keep = blank_to_null(F.col("bioguide")).isNotNull() & (F.length(day) == 10) & ~F.coalesce("is_procedural", F.lit(False))
    return turns.filter(keep).withColumn("bioguide", F.trim("bioguide")).withColumn("date", day)


def score_spoken(turns: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores of the spoken text, and ``profanity_quoted_hits`` of what is quoted."""
    spoken, quoted = mask_quotes(F.coalesce("text", F.lit("")))
    parts = turns.withColumn("_quoted", F.lower(quoted)).withColumn("text", spoken)
    inside = scorer.profanity_counts(F.col("_quoted"), tokens(F.col("_quoted")))
    hits = F.when(F.col("_quoted") == "", 0).otherwise(inside["profanity_mild"] + inside["profanity_strong"])
    scored = score_turns(parts.withColumn("profanity_quoted_hits", hits.cast("long")), scorer)
    return scored.select(*[c for c in turns.columns if c != "text"], "profanity_quoted_hits", "n_words", *HITS)


def latest(value: Column, order: Column) -> Column:
    """The value at the greatest ``order`` among rows where it is not blank; '' if none."""
    known = blank_to_null(value)
    return F.coalesce(F.max_by(known, F.when(known.isNotNull(), order)), F.lit(""))


def member_day(scored: DataFrame) -> DataFrame:
    """Counts by member, day and chamber, with each member's latest name, party and state.

    ``scored`` needs ``pos``, the reading order of its rows. Congress is the row's own.
    """
    order = F.struct("date", "pos")
    keyed = scored.withColumn("chamber", F.coalesce(blank_to_null(F.col("chamber")), F.lit("other")))
    days = keyed.groupBy("bioguide", "date", "chamber").agg(
        F.coalesce(F.max_by("congress", "pos"), F.lit(0)).alias("congress"), F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"),
        *(F.sum(c).alias(c) for c in COUNTS[2:]),
    )
    who = keyed.groupBy("bioguide").agg(
        latest(F.col("speaker_name"), order).alias("speaker_name"),
        F.max_by(F.coalesce(blank_to_null(F.col("party")), F.lit("other")), order).alias("party"),
        latest(F.col("state"), order).alias("state"),
    )
    return days.join(who, "bioguide").select("bioguide", "date", "chamber", "speaker_name", "party", "state", "congress", *COUNTS)


def rates_per_100k(hits=HITS) -> list[Column]:
    return [rate(F.col(h), F.col("words"), PER).alias(h.replace("_hits", "_per_100k")) for h in hits]


def in_congress(rows: DataFrame, congress: int | None) -> DataFrame:
    return rows if congress is None else rows.filter(F.col("congress") == congress)


def speech_totals(daily: DataFrame, congress: int | None = None) -> DataFrame:
    """One row a member over floor speech; attributes are those of the last stored row."""
    rows = in_congress(daily, congress).filter(F.col("chamber").isin(*FLOOR))
    order = F.struct("congress", "date", "chamber")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("speaker_name", "party", "state", "chamber")]
    return rows.groupBy("bioguide").agg(*last, *(F.sum(c).alias(c) for c in COUNTS), F.count_distinct("date").alias("active_days"))


def bill_totals(bills: DataFrame, congress: int | None = None) -> DataFrame:
    rows = in_congress(bills, congress).filter(blank_to_null(F.col("sponsor_bioguide")).isNotNull())
    order = F.struct("congress", "bill_type", "bill_number")
    named = {"speaker_name": "sponsor_name", "party": "sponsor_party", "state": "sponsor_state", "chamber": "origin_chamber"}
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(k) for k, v in named.items()]
    totals = rows.groupBy(F.col("sponsor_bioguide").alias("bioguide")).agg(
        *last, F.count_distinct("bill_id").alias("bills_sponsored"), F.count_if("passed_any_chamber").alias("bills_passed"), F.count_if("became_law").alias("bills_enacted")
    )
    share = lambda c: rate(F.col(c), F.col("bills_sponsored"), 1)
    return totals.withColumn("passage_share", share("bills_passed")).withColumn("enactment_share", share("bills_enacted"))


def member_activity(speech: DataFrame, bills: DataFrame) -> DataFrame:
    """Full outer join of speech and bill totals; attributes from speech, then bills; counts 0 where absent."""
    s, b = speech.alias("s"), bills.alias("b")
    both = s.join(b, F.col("s.bioguide") == F.col("b.bioguide"), "full_outer")
    text = [F.coalesce(f"s.{c}", f"b.{c}", F.lit("")).alias(c) for c in ("speaker_name", "party", "state", "chamber")]
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*COUNTS[:2], "active_days", *COUNTS[2:], "bills_sponsored", "bills_passed", "bills_enacted")]
    shares = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("passage_share", "enactment_share")]
    flat = both.select(F.coalesce("s.bioguide", "b.bioguide").alias("bioguide"), *text, *counts, *shares)
    return flat.select("*", *rates_per_100k())


def board(rows: DataFrame, order: list[str], top: int = TOP, where: Column | None = None, tie: str = "bioguide") -> DataFrame:
    """Top rows by descending ``order``, ties by id; rank is the position.

    The rows are first cut to ``top`` by a distributed top-k, so the window only numbers those.
    """
    chosen = rows if where is None else rows.filter(where)
    keys = [F.col(c).desc() for c in order] + [F.col(tie).asc()]
    best = chosen.orderBy(*keys).limit(top)
    return best.select(F.row_number().over(Window.orderBy(*keys)).cast("long").alias("rank"), "*")


def activity_boards(activity: DataFrame, top: int = TOP, min_words: int = MIN_WORDS) -> dict[str, DataFrame]:
    c = F.col
    return {
        "speech": board(activity, ["words", "turns"], top, c("words") > 0),
        "sponsored": board(activity, ["bills_sponsored", "bills_passed"], top, c("bills_sponsored") > 0),
        "passed": board(activity, ["bills_passed", "bills_sponsored"], top, c("bills_passed") > 0),
        "enacted": board(activity, ["bills_enacted", "bills_sponsored"], top, c("bills_enacted") > 0),
        "profanity": board(activity, ["profanity_per_100k", "profanity_hits"], top, (c("words") >= min_words) & (c("profanity_hits") > 0)),
    }


def profanity_board(daily: DataFrame, congress: int | None = None, top: int = TOP, min_words: int = MIN_WORDS) -> DataFrame:
    """By profanity rate over all chambers, with the first and last day."""
    order = F.struct("congress", "date", "chamber")
    last = [F.max_by(c, order).alias(c) for c in ("speaker_name", "party", "state", "chamber")]
    sums = [F.sum(c).alias(c) for c in COUNTS[:4]]
    grouped = in_congress(daily, congress).groupBy("bioguide").agg(*last, *sums, F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return board(grouped.select("*", *rates_per_100k(("profanity_hits",))), ["profanity_per_100k", "profanity_hits"], top, F.col("words") >= min_words)


def language_boards(daily: DataFrame, congress: int | None = None, top: int = 8, min_words: int = MIN_WORDS, chamber: str | None = None) -> DataFrame:
    """Three boards in one: metric, rank, member, hits and rate. One shuffle for totals, one for ranks."""
    rows = daily if chamber is None else daily.filter(F.col("chamber") == chamber)
    totals = speech_totals(rows, congress).filter(F.col("words") >= min_words).select("*", *rates_per_100k())
    each = F.array(*[F.struct(F.lit(h.removesuffix("_hits")).alias("metric"), F.col(h).alias("hits"), F.col(h.replace("_hits", "_per_100k")).alias("rate_per_100k")) for h in HITS])
    long = totals.select("bioguide", "speaker_name", "party", "state", "chamber", "words", "turns", "active_days", F.inline(each)).filter("hits > 0")
    w = Window.partitionBy("metric").orderBy(F.desc("rate_per_100k"), F.desc("hits"), "bioguide")
    return long.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def examples(members: DataFrame, bills: DataFrame, top: int = 3) -> DataFrame:
    """Each member's newest bills: introduced descending, type ascending, number descending."""
    w = Window.partitionBy("bioguide").orderBy(F.desc("introduced_date"), F.asc("bill_type"), F.desc("bill_number"))
    named = bills.withColumnRenamed("sponsor_bioguide", "bioguide").join(members.select("bioguide"), "bioguide", "left_semi")
    return named.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
