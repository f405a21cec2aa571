"""Canonical bills from nested records: milestones, laws, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.domain import bill_id, blank_to_null, chamber_of, without_key
from lectern.operators.coverage import reconcile
from lectern.operators.dedup import replace_groups, upsert

# Action codes and action texts of passage and enactment.
PASSED_HOUSE, PASSED_SENATE, ENACTED = ("8000",), ("17000",), ("36000",)
PASSED_HOUSE_TEXT = r"(?i)\A(?:passed(?:/agreed to)? in house|passed house)\b"
PASSED_SENATE_TEXT = r"(?i)\A(?:passed(?:/agreed to)? in senate|passed senate)\b"
ENACTED_TEXT = r"(?i)\Abecame (?:public|private) law\b"
LAW_NUMBER, LAW_TYPES = r"\A[1-9]\d*-[1-9]\d*\z", ("public law", "private law")
ACTION = "struct<actionDate:string,actionCode:string,text:string>"


def _is(a: Column, codes: tuple, pattern: str) -> Column:
    return F.coalesce(F.trim(a["actionCode"]).isin(*codes), F.lit(False)) | F.coalesce(F.trim(a["text"]).rlike(pattern), F.lit(False))


def milestones(actions: Column) -> dict[str, Column]:
    """Passage and enactment flags, first dates ('' if none) and sorted distinct matched codes as JSON text."""
    rules = {"house": (PASSED_HOUSE, PASSED_HOUSE_TEXT), "senate": (PASSED_SENATE, PASSED_SENATE_TEXT), "law": (ENACTED, ENACTED_TEXT)}
    hits = {k: _matching(actions, *rule) for k, rule in rules.items()}

    def first_day(found: Column) -> Column:
        days = F.filter(F.transform(found, lambda a: F.substring(F.coalesce(a["actionDate"], F.lit("")), 1, 10)), lambda d: d != "")
        return F.coalesce(F.array_min(days), F.lit(""))

    codes = F.filter(F.transform(F.concat(*hits.values()), lambda a: F.trim(F.coalesce(a["actionCode"], F.lit("")))), lambda c: c != "")
    quoted = F.transform(F.array_sort(F.array_distinct(codes)), lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    passed_house, passed_senate = F.size(hits["house"]) > 0, F.size(hits["senate"]) > 0
    return {
        "passed_house": passed_house, "passed_house_date": first_day(hits["house"]),
        "passed_senate": passed_senate, "passed_senate_date": first_day(hits["senate"]),
        "passed_any_chamber": passed_house | passed_senate, "became_law_date": first_day(hits["law"]),
        "matched_action_codes": F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")),
    }


def _matching(actions: Column, codes: tuple, pattern: str) -> Column:
    return F.filter(actions, lambda a: _is(a, codes, pattern))


def chosen_law(laws: Column, congress: Column) -> Column:
    """The first well-formed law (``congress-number``) of the bill's own congress, else the first; null if none."""
    good = F.filter(laws, lambda x: F.coalesce(F.trim(x["number"]).rlike(LAW_NUMBER) & F.lower(F.trim(x["type"])).isin(*LAW_TYPES), F.lit(False)))
    own = F.filter(good, lambda x: F.split_part(x["number"], F.lit("-"), F.lit(1)).try_cast("int") == congress)
    return F.coalesce(F.get(own, F.lit(0)), F.get(good, F.lit(0)))


def canonical(raw: DataFrame, *keep: str) -> DataFrame:
    """Flat bills from congress, type, number, title, origin, sponsors[], actions[], laws[], dates."""
    sponsor = F.get("sponsors", F.lit(0))
    law = chosen_law(F.col("laws"), F.col("congress"))
    name = lambda f: F.coalesce(sponsor[f], F.lit(""))
    return raw.select(
        bill_id(F.col("congress"), F.col("type"), F.col("number")).alias("bill_id"),
        F.col("congress").cast("long").alias("congress"), F.lower("type").alias("bill_type"), F.col("number").cast("long").alias("bill_number"),
        F.coalesce("title", F.lit("")).alias("title"), chamber_of(F.col("origin")).alias("origin_chamber"),
        name("bioguideId").alias("sponsor_bioguide"), name("fullName").alias("sponsor_name"), name("party").alias("sponsor_party"), name("state").alias("sponsor_state"),
        F.coalesce("introduced_date", F.lit("")).alias("introduced_date"), *(v.alias(k) for k, v in milestones(F.col("actions")).items()),
        (F.size("laws") > 0).alias("became_law"), F.coalesce(law["type"], F.lit("")).alias("law_type"), F.coalesce(law["number"], F.lit("")).alias("law_number"), *keep,
    )


# Flags of a bill, and what chambers are called.
FLAGS = ("passed_house", "passed_senate", "passed_any_chamber", "became_law")
CHAMBERS = {"h": "house", "s": "senate"}


def normalized(bills: DataFrame, order: Column | None = None) -> DataFrame:
    """Typed, filled and checked bills, one row a bill_id (the last in ``order``), sorted by congress, type and number.

    Without ``order`` it is the one whose JSON is largest, a rule that no partitioning changes.
    Numbers that are none, and rows that :func:`violations` names, fail the job.
    """
    chamber = F.lower(F.trim(F.coalesce("origin_chamber", F.lit(""))))
    for short, long in CHAMBERS.items():
        chamber = F.when(chamber == short, long).otherwise(chamber)
    typed = bills.withColumns({"congress": F.col("congress").cast("long"), "bill_number": F.col("bill_number").cast("long"), "origin_chamber": chamber})
    typed = typed.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in FLAGS if c in bills.columns})
    problem = F.concat_ws(", ", problems())
    bad = F.raise_error(F.concat(F.lit("bill "), F.coalesce("bill_id", F.lit("without id")), F.lit(": "), problem)).cast("boolean")
    typed = typed.filter(F.when(problem == "", True).otherwise(bad))
    last = Window.partitionBy("bill_id").orderBy((F.to_json(F.struct(*sorted(typed.columns))) if order is None else order).desc())
    typed = typed.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    return typed.orderBy("congress", "bill_type", "bill_number")


def violations(bills: DataFrame) -> DataFrame:
    """(bill_id, problem) for rows whose id does not fit, whose type is unknown or that are law but never passed."""
    return bills.select("bill_id", F.explode(problems()).alias("problem"))


def problems() -> Column:
    checks = {
        "id": F.col("bill_id") != F.concat_ws("-", F.col("congress").cast("string"), "bill_type", F.col("bill_number").cast("string")),
        "type": ~F.col("bill_type").isin("hr", "s"),
        "enacted but not passed": F.col("became_law") & ~F.col("passed_any_chamber"),
        "number": F.col("bill_number") <= 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(k == "id")), F.lit(k)) for k, c in checks.items()]))


#: A bill of the REST service with its actions, as far as it is used.
PAYLOAD = (
    "congress string, type string, number string, title string, originChamberCode string, originChamber string, introducedDate string, url string, "
    "updateDateIncludingText string, updateDate string, sponsors array<struct<bioguideId:string,fullName:string,name:string,party:string,state:string>>, "
    f"laws array<struct<type:string,number:string>>, actions array<{ACTION}>"
)


def rest_bills(payloads: DataFrame, base_url: str) -> DataFrame:
    """Canonical bills of (payload): one JSON object of the service a row. A payload without congress or number fails the job.

    Keys in urls are masked; a bill without url gets the service's.
    """
    p = payloads.select(F.from_json("payload", PAYLOAD).alias("p")).select("p.*")
    whole = lambda c: F.col(c).try_cast("int")
    bad = F.raise_error(F.lit("bill payload is missing a valid congress or number")).cast("boolean")
    p = p.filter(F.when(F.coalesce((whole("congress") > 0) & (whole("number") > 0), F.lit(False)), True).otherwise(bad))
    sponsors = F.transform(F.coalesce("sponsors", F.array().cast("array<struct<bioguideId:string,fullName:string,name:string,party:string,state:string>>")), lambda s: F.struct(
        s["bioguideId"].alias("bioguideId"), F.coalesce(blank_to_null(s["fullName"]), s["name"]).alias("fullName"), s["party"].alias("party"), s["state"].alias("state"),
    ))
    own_url = F.concat_ws("/", F.lit(base_url.rstrip("/") + "/bill"), "congress", F.lower("type"), "number")
    raw = p.select(
        whole("congress").alias("congress"), F.lower(F.trim("type")).alias("type"), whole("number").alias("number"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(blank_to_null(F.col("originChamberCode")), F.col("originChamber")).alias("origin"), F.col("introducedDate").alias("introduced_date"), sponsors.alias("sponsors"),
        F.coalesce("actions", F.array().cast(f"array<{ACTION}>")).alias("actions"), F.coalesce("laws", F.array().cast("array<struct<type:string,number:string>>")).alias("laws"),
        without_key(F.coalesce(blank_to_null(F.col("url")), own_url)).alias("source_url"), F.coalesce(blank_to_null(F.col("updateDateIncludingText")), F.col("updateDate"), F.lit("")).alias("source_updated_at"),
    )
    return canonical(raw, "source_url", "source_updated_at")


def update_bills(known: DataFrame | None, fresh: DataFrame, full: bool, order: Column | None = None) -> DataFrame:
    """The next bill table, checked: a full run replaces every congress that ``fresh`` has, another one single bills.

    Of fresh rows of one bill the last in ``order`` counts, see :func:`normalized`.
    """
    if known is None:
        return normalized(fresh, order)
    return normalized(replace_groups(known, fresh, "congress") if full else upsert(known, fresh, ["bill_id"]), order)


def next_batch(wanted: DataFrame, checkpoint: DataFrame, known: DataFrame, size: int = 100) -> DataFrame:
    """The first ``size`` wanted bill_ids, in order, that are not both checkpointed and stored: a resumed seeding goes on there."""
    done = reconcile(checkpoint.select("bill_id"), known, "bill_id")
    return wanted.select("bill_id").distinct().join(done, "bill_id", "left_anti").orderBy("bill_id").limit(size)
