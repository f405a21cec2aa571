"""Bill status XML of both schema generations, directory listings and ZIP archives of bills."""

from __future__ import annotations

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.domain import listing_time
from lectern.operators.bills import canonical
from lectern.sources import archives

# Limits of an archive: bytes of an entry, entries, bytes of all entries.
MAX_BYTES, MAX_ENTRIES, MAX_TOTAL = 25 << 20, 100_000, 2 << 30
# Element names of the two schema generations.
_PERSON = "struct<bioguideId:string,fullName:string,party:string,state:string,isByRequest:string>"
_ACTION = "struct<actionDate:string,actionCode:string,text:string>"
_LAW = "struct<type:string,number:string>"
BILL = (
    "congress int, type string, billType string, number int, billNumber int, title string, originChamber string, introducedDate string, updateDate string, "
    f"sponsors struct<item:array<{_PERSON}>>, actions struct<item:array<{_ACTION}>>, laws struct<item:array<{_LAW}>>"
)
LISTED = r"BILLSTATUS-(\d+)(hr|s)(\d+)\.xml"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, file, xml, modified) of the bill documents in all archives, read member by member.

    An archive over its limits, a bill twice in one archive or a document type declaration fails the read. The limits
    are checked on the directories, before any document is read.
    """
    found = archives.index(spark, path)
    is_bill = archives.base_name(F.col("member")).rlike(rf"\A{LISTED}\z")
    bills = found.filter(is_bill)
    name = F.when(is_bill, archives.base_name(F.col("member")))
    sums = found.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("size").alias("total"), F.max(F.when(is_bill, F.col("size"))).alias("largest"),
        (F.count(name) - F.count_distinct(name)).alias("repeats"),
    )
    bad = sums.filter((F.col("entries") > MAX_ENTRIES) | (F.col("total") > MAX_TOTAL) | (F.col("largest") > MAX_BYTES) | (F.col("repeats") > 0)).orderBy("archive").first()
    if bad is not None:
        raise PySparkValueError(f"a bill twice in {bad['archive']}" if bad["repeats"] else f"archive over its limits: {bad['archive']}")
    xml = F.decode("content", "UTF-8")
    wrong = F.raise_error(F.concat(F.lit("document type declaration in "), F.col("member"))).cast("string")
    rows = archives.contents(bills).withColumn("xml", xml)
    checked = F.when(F.contains("xml", F.lit("<!DOCTYPE")) | F.contains("xml", F.lit("<!ENTITY")), wrong).otherwise(F.col("xml"))
    return rows.select("archive", F.col("member").alias("file"), checked.alias("xml"), F.concat(F.substring("modified", 1, 17), F.lit("00")).alias("modified"))


def checked_bills(archives: DataFrame) -> DataFrame:
    """Bills of :func:`read_archives`, each with the identity that its file name says; another one fails the job."""
    name = F.element_at(F.split("file", "/"), -1)
    named = F.concat_ws("-", *[F.regexp_extract(name, LISTED, i) for i in (1, 2, 3)])
    bills = parse_bills(archives, named.alias("_named"), F.col("modified").alias("source_updated_at"))
    wrong = F.raise_error(F.concat(F.lit("the document of "), F.col("_named"), F.lit(" says "), F.coalesce("bill_id", F.lit("nothing")))).cast("boolean")
    return bills.filter(F.when(F.col("bill_id").eqNullSafe(F.col("_named")), True).otherwise(wrong)).drop("_named")


def parse_bills(xml: DataFrame, *keep: Column) -> DataFrame:
    """Canonical bills from (xml): one ``billStatus`` document a row; element names may carry a namespace prefix."""
    inner = F.regexp_replace(F.regexp_extract("xml", r"(?s)(<(?:\w+:)?bill>.*</(?:\w+:)?bill>)", 1), r"(</?)\w+:", "$1")
    bill = F.from_xml(inner, BILL, {"rowTag": "bill"}).alias("b")
    kept = xml.select(*keep).columns
    r = xml.select(bill, *keep).select("b.*", *kept)
    some = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>"))
    raw = r.select(
        "congress", F.coalesce("type", "billType").alias("type"), F.coalesce("number", "billNumber").alias("number"), "title", F.col("originChamber").alias("origin"),
        F.col("introducedDate").alias("introduced_date"), some("sponsors.item", _PERSON).alias("sponsors"), some("actions.item", _ACTION).alias("actions"), some("laws.item", _LAW).alias("laws"), *kept,
    )
    return canonical(raw, *kept)


def parse_listing(xml: Column) -> Column:
    """Array of (congress, bill_type, bill_number, url, modified) from a directory listing document, in order."""
    inner = F.regexp_extract(xml, r"(?s)(<files>.*</files>)", 1)
    files = F.from_xml(inner, "file array<struct<name:string,link:string,formattedLastModifiedTime:string>>", {"rowTag": "files"})["file"]
    bills = F.filter(F.coalesce(files, F.array().cast("array<struct<name:string,link:string,formattedLastModifiedTime:string>>")), lambda f: f["name"].rlike(rf"\A{LISTED}\z"))
    part = lambda f, i: F.regexp_extract(f["name"], LISTED, i)
    return F.array_sort(F.transform(bills, lambda f: F.struct(
        part(f, 1).cast("int").alias("congress"), part(f, 2).alias("bill_type"), part(f, 3).cast("int").alias("bill_number"), f["link"].alias("url"),
        listing_time(f["formattedLastModifiedTime"]).alias("modified"),
    )))
