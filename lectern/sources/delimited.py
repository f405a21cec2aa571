"""Pipe-delimited latin-1 speech archives: speeches, descriptions and a speaker map, joined to turns.

The files have no quoting and speech text may hold the delimiter, so lines are split, not parsed as CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.domain import blank_to_null, chamber_of, iso_date, party_of
from lectern.operators.dedup import keep_first
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored
from lectern.sources import archives
from lectern.sources.ranges import list_files

# Field places and the labels of presiding roles.
DESCRIPTION = {"speech_id": 0, "chamber": 1, "date": 2, "speaker": 4, "state": 7, "word_count": 13}
SPEAKER_MAP = {"speakerid": 0, "speech_id": 1, "lastname": 2, "firstname": 3, "chamber": 4, "state": 5, "party": 7}
PRESIDING = (
    r"(?i)\A\s*(the\s+)?(vice\s+president|president\s+pro\s+tempore|presiding\s+officer|speaker(\s+pro\s+tempore)?|acting\s+president|"
    r"chief\s+clerk|the\s+clerk|clerk|chairman|chairwoman|the\s+chair)\b"
)


def read_lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(fields, pos, congress) of the lines that are neither blank nor the header; congress from the file name."""
    text = spark.read.option("lineSep", "\n").text(path)  # the text source keeps bytes as they are
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"\r\z", "")
    rows = text.select(line.alias("line"), F.monotonically_increasing_id().alias("pos"), F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("int").alias("congress"))
    return rows.filter((F.trim("line") != "") & ~F.startswith("line", F.lit(header))).select(F.split("line", r"\|", -1).alias("fields"), "pos", "congress")


def read_zipped_lines(spark: SparkSession, path: str, member: str, header: str) -> DataFrame:
    """As :func:`read_lines` from archives: the members whose name holds ``member``, each read by range and line by line.

    Unreadable archives, such as half a download, have no members.
    """
    found = archives.index(spark, path, skip_unreadable=True)
    return zipped_lines(found.filter(F.contains(archives.base_name(F.col("member")), F.lit(member))), header)


def zipped_lines(members: DataFrame, header: str) -> DataFrame:
    rows = archives.lines(members)
    kept = rows.filter((F.trim("line") != "") & ~F.startswith("line", F.lit(header)))
    return kept.select(F.split("line", r"\|", -1).alias("fields"), "pos", F.regexp_extract(archives.base_name(F.col("member")), r"(\d+)", 1).cast("int").alias("congress"))


def available_congresses(spark: SparkSession, path: str) -> list[int]:
    """Congress numbers that speech files below ``path``, loose or in archives, name; unreadable archives have none."""
    loose = list_files(spark, path, "speeches_*.txt").select(F.col("path").alias("name"))
    zipped = archives.index(spark, path, skip_unreadable=True).select(F.col("member").alias("name"))
    names = loose.unionByName(zipped).select(F.regexp_extract("name", r"speeches_(\d+)\.txt\z", 1).alias("n")).filter("n <> ''").distinct()
    return sorted(int(r["n"]) for r in names.collect())  # one small row a congress


def _indexed(lines: DataFrame, places: dict[str, int], at_least: int) -> DataFrame:
    """Named fields of the lines long enough; of one speech the last line counts."""
    rows = lines.filter(F.size("fields") >= at_least)
    named = rows.select("pos", "congress", *[F.get("fields", F.lit(i)).alias(k) for k, i in places.items()])
    return keep_first(named, ["congress", "speech_id"], [F.col("pos").desc()]).drop("pos")


def speech_turns(spark: SparkSession, speeches: str, descriptions: str, speaker_map: str, edition: str) -> DataFrame:
    """Turns of an edition (``bound`` or ``daily``) from folders or files of its three kinds."""
    read = lambda path, header: read_lines(spark, path, header)
    return join_speeches(read(speeches, "speech_id|"), read(descriptions, "speech_id|"), read(speaker_map, "speakerid|"), edition)


def zipped_turns(spark: SparkSession, path: str, edition: str) -> DataFrame:
    """Turns of an edition from ZIP archives that hold its three kinds of files; their directories are read once."""
    found = archives.index(spark, path, skip_unreadable=True)
    read = lambda member, header: zipped_lines(found.filter(F.contains(archives.base_name(F.col("member")), F.lit(member))), header)
    return join_speeches(read("speeches_", "speech_id|"), read("descr_", "speech_id|"), read("SpeakerMap", "speakerid|"), edition)


def join_speeches(s: DataFrame, descriptions: DataFrame, speaker_map: DataFrame, edition: str) -> DataFrame:
    """Speeches with their description and speaker; blank fields fall back from description to speaker map."""
    source = f"hein_{edition}"
    s = s.select("congress", "pos", F.get("fields", F.lit(0)).alias("speech_id"), F.array_join(F.slice("fields", 2, F.size("fields")), "|").alias("text"))
    d = _indexed(descriptions, DESCRIPTION, 14).alias("d")
    m = _indexed(speaker_map, SPEAKER_MAP, 8).alias("m")
    j = s.alias("s").join(d, ["congress", "speech_id"], "left").join(m, ["congress", "speech_id"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = lambda *cs: F.coalesce(*[blank_to_null(F.col(c)) for c in cs], F.lit(""))
    name = F.coalesce(blank_to_null(F.col("d.speaker")), F.trim(F.concat_ws(" ", blank("m.firstname"), blank("m.lastname"))))
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return j.select(
        F.concat(F.lit(f"{source}:"), "speech_id").alias("turn_id"), F.lit(source).alias("source"), iso_date(blank("d.date")).alias("date"), "congress",
        chamber_of(first("d.chamber", "m.chamber")).alias("chamber"), name.alias("speaker_name"), blank("m.speakerid").alias("speaker_id"), F.lit("").alias("bioguide"),
        party_of(F.col("m.party")).alias("party"), F.trim(first("m.state", "d.state")).alias("state"),
        F.coalesce(F.trim("d.word_count").try_cast("bigint"), words.cast("bigint")).alias("word_count"), name.rlike(PRESIDING).alias("is_procedural"), "text",
    )


def edition_regime(turns: DataFrame, first_daily: int = 97) -> DataFrame:
    """Daily edition from ``first_daily`` on, bound before it; the bound edition fills congresses the daily one lacks."""
    daily = turns.filter("source = 'hein_daily'").select("congress").distinct().withColumn("has_daily", F.lit(True))
    marked = turns.join(small_or_shuffled(stored(daily, "daily-congresses"), 100_000), "congress", "left")
    use_daily = (F.col("congress") >= first_daily) & F.coalesce("has_daily", F.lit(False))
    return marked.filter(F.when(use_daily, F.col("source") == "hein_daily").otherwise(F.col("source") == "hein_bound")).drop("has_daily")
