"""Daily packages (ZIP of MODS and HTML), granule metadata and manifests."""

from __future__ import annotations

import html
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.domain import blank_to_null, congress_or_date, content_fingerprint
from lectern.operators.dedup import drop_repeated_content, keep_first, prefer_unflagged
from lectern.operators.segments import turns_of
from lectern.plans.scratch import stored
from lectern.schema import MEMBERS
from lectern.sources import archives

PACKAGE_DATE = r"(\d{4}-\d{2}-\d{2})"


@F.arrow_udf(StringType())
def decoded(text: pa.Array) -> pa.Array:
    """All numeric and named references decoded once."""
    return pa.array([x if x is None or "&" not in x else html.unescape(x) for x in text.to_pylist()], pa.string())


# White space besides the line feed, as a character class.
SPACE = r"\t\x0b\x0c\x1c-\x1f\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A tag: a ``>`` may stand in a quoted value, a ``<`` ends what only looked like a tag.
TAG = r"""<[A-Za-z/!?](?:[^<>"']|"[^"<]*+"|'[^'<]*+'|["'])*+>"""
#: Comments, scripts and styles; one that is not closed reaches to the end.
UNSEEN = r"(?i)<!--(?:[^-]|-(?!->))*+(?:-->|\z)|<(script|style)\b[^<]*+(?:<(?!/\1\b)[^<]*+)*+(?:</\1[^<>]*+>?|\z)"
PRE = r"(?i)<pre\b[^<>]*+>([^<]*+(?:<(?!/pre\b)[^<]*+)*+)"


def html_text(source: Column) -> Column:
    """Text of the first ``pre`` element, or of all: tags, comments, scripts and styles out, references decoded, lines trimmed, blank lines capped at one.

    All patterns are possessive and each match consumes what it has read, so the time is in proportion to the source.
    """
    seen = F.regexp_replace(source, UNSEEN, "")
    body = F.when(seen.rlike(PRE), F.regexp_extract(seen, PRE, 1)).otherwise(seen)
    plain = decoded(F.regexp_replace(body, TAG, ""))
    lines = F.regexp_replace(plain, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    trimmed = F.regexp_replace(lines, rf"(?<![{SPACE}])[{SPACE}]++(?=\n|\z)", "")
    whole = F.regexp_replace(trimmed, rf"\A[{SPACE}\n]++|(?<![{SPACE}\n])[{SPACE}\n]++\z", "")
    return F.concat(F.regexp_replace(whole, r"\n{3,}+", "\n\n"), F.lit("\n"))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _last(element: ElementTree.Element, name: str) -> str:
    return ([e.text.strip() for e in element.iter() if _local(e) == name and e.text] or [""])[-1]


def _display_name(member: ElementTree.Element) -> str:
    named = {e.get("type", ""): (e.text or "").strip() for e in member.iter() if _local(e) == "name"}
    return next((named[k] for k in ("authority-fnf", "authority-lnf", "parsed") if named.get(k)), "")


def parse_mods(content: bytes, whole: bool = True) -> list[dict]:
    """One dict a constituent: id, class, chamber, members, congress. [] if not XML.

    Without constituents there is one dict for the whole document if ``whole``, else none.
    """
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    numbers = [int(e.text) for e in root.iter() if _local(e) == "congress" and (e.text or "").strip().isdigit()]
    congress = next((n for n in numbers if n > 0), 0)
    parts = [e for e in root.iter() if _local(e) == "relatedItem" and e.get("type") == "constituent"] or [root] * whole
    out = []
    for part in parts:
        members = [
            {"party": m.get("party", ""), "bioguide": m.get("bioGuideId", ""), "name": _display_name(m), "state": m.get("state", "")}
            for m in part.iter() if _local(m) == "congMember"
        ]
        gid = (part.get("ID") or "").removeprefix("id-") or _last(part, "accessId")
        out.append({"granule_id": gid, "granule_class": _last(part, "granuleClass"), "chamber": _last(part, "chamber"), "members": members, "congress": congress})
    return out


def _granules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("archive", pa.string()), ("place", pa.int32()), ("granule_id", pa.string()), ("congress", pa.int32()), ("granule_class", pa.string()), ("chamber", pa.string()),
        ("members", pa.list_(pa.struct([(k, pa.string()) for k in ("party", "bioguide", "name", "state")]))),
    ])
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
            granules = {g["granule_id"]: g for g in parse_mods(content.as_py(), whole=False) if g["granule_id"]}
            yield pa.RecordBatch.from_pylist([g | {"archive": archive, "place": k} for k, g in enumerate(granules.values())], schema=schema)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Granules of all package archives below ``path``, html as it is; ``place`` is their place in the package's MODS.

    The MODS of each archive are read first and joined to its directory, so that only the pages of granules are read,
    by range and by as many tasks as their bytes need. A granule without a page is left out; of pages of one name the last counts.
    """
    found = archives.index(spark, path)
    name = archives.base_name(F.col("member"))
    mods = keep_first(found.filter(F.endswith("member", F.lit("mods.xml"))), ["archive"], [F.col("place")])
    granules = stored(archives.contents(mods).select("archive", "content").mapInArrow(_granules, f"archive string, place int, granule_id string, congress int, granule_class string, chamber string, members {MEMBERS}"), "package-granules")
    pages = keep_first(found.filter(F.endswith("member", F.lit(".htm"))).withColumn("granule_id", F.regexp_replace(name, r"\.htm\z", "")), ["archive", "granule_id"], [F.col("place").desc()]).drop("place")
    wanted = stored(pages.join(granules, ["archive", "granule_id"]), "package-pages")
    rows = archives.contents(wanted)
    package = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.zip\z", "")
    return rows.select(
        package.alias("package"), "place", "granule_id", "congress", "granule_class", "chamber", F.regexp_extract(package, PACKAGE_DATE, 1).alias("date"), "members",
        page_text(F.col("content")).alias("text"),
    )


@F.arrow_udf(StringType())
def page_text(content: pa.Array) -> pa.Array:
    """UTF-8 with bad bytes replaced."""
    return pa.array([None if x is None else x.decode("utf-8", "replace") for x in content.to_pylist()], pa.string())


def package_turns(granules: DataFrame, classes: tuple[str, ...] | None = None) -> DataFrame:
    """Turns of the granules (of ``classes`` if given); long turns repeated within a package count once, the first.

    The granule's class decides the chamber, then its chamber; other classes are chamber ``other``. Granules whose
    congress neither MODS nor the date tells are left out.
    """
    from lectern.functions.domain import chamber_of

    rows = granules if classes is None else granules.filter(F.upper("granule_class").isin(*classes))
    rows = rows.withColumn("text", html_text(F.col("text"))).withColumn("chamber", chamber_of(F.coalesce(blank_to_null(F.col("granule_class")), F.col("chamber"))))
    rows = rows.withColumn("congress", congress_or_date(F.col("congress"), F.col("date"))).filter("congress > 0")
    turns = turns_of(rows, "package", "place")
    procedural = F.when(F.col("is_procedural"), "1").otherwise("0")
    same = content_fingerprint(F.col("text"), F.col("bioguide"), F.col("speaker_name"), F.col("chamber"), procedural)
    order = [F.col("place"), F.col("segment"), F.endswith("turn_id", F.lit("-inserted"))]
    return drop_repeated_content(turns, "package", same, order).drop("package", "place", "segment")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines; malformed ones have ``_corrupt_record`` set."""
    schema = "granuleId string, dateIssued string, txt_path string, mods_path string, congress string, backfilled boolean, _corrupt_record string"
    rows = spark.read.text(path).filter(F.trim("value") != "")
    parsed = rows.select(F.monotonically_increasing_id().alias("pos"), "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.select("pos", "r.*")


def merge_manifests(rows: DataFrame) -> DataFrame:
    """One row a granule: not backfilled before backfilled, then the first."""
    return prefer_unflagged(rows.filter("_corrupt_record IS NULL"), "granuleId", "backfilled", [F.col("pos")])


def to_do(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    return wanted.join(manifest.select("granuleId").distinct(), "granuleId", "left_anti")


def granule_metadata(granules: DataFrame) -> DataFrame:
    """Flat metadata of each granule: sorted distinct member names and ids."""
    distinct = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform("members", lambda m: m[f]), lambda x: x != "")))
    return granules.select("granule_id", "granule_class", "chamber", "congress", "date", distinct("name").alias("names"), distinct("bioguide").alias("ids"))


def of_class(granules: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    return granules.filter(F.upper("granule_class").isin(*classes))


_MODS_TEXTS = {
    "granule_class": ("granuleClass",), "sub_class": ("subGranuleClass",), "title": ("searchTitle", "title"), "page_prefix": ("pagePrefix",), "chamber": ("chamber",),
    "congress": ("congress",), "session": ("session",), "volume": ("volume",), "issue": ("issue",), "date": ("dateIssued",),
}
GRANULE_MODS = ", ".join(f"{k} string" for k in ("file", *_MODS_TEXTS, "citation")) + f", members {MEMBERS}, names array<string>, ids array<string>, parse_error string"


def _granule_mods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        *((k, pa.string()) for k in ("file", *_MODS_TEXTS, "citation")), ("members", pa.list_(pa.struct([(k, pa.string()) for k in ("party", "bioguide", "name", "state")]))),
        ("names", pa.list_(pa.string())), ("ids", pa.list_(pa.string())), ("parse_error", pa.string()),
    ])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = {"file": path.rsplit("/", 1)[-1]}
            try:
                root = ElementTree.fromstring(content.as_py())
            except ElementTree.ParseError as error:
                rows.append(row | {"parse_error": str(error)})
                continue
            texts: dict[str, str] = {}
            for e in root.iter():
                if (e.text or "").strip():
                    texts.setdefault(_local(e), e.text.strip())
                    if _local(e) == "identifier" and e.get("type") == "congressional record citation":
                        row.setdefault("citation", e.text.strip())
            row |= {k: next((texts[n] for n in names if n in texts), None) for k, names in _MODS_TEXTS.items()}
            members = parse_mods(content.as_py())[0]["members"]
            distinct = {k: sorted({m[f] for m in members if m[f]}) for k, f in (("names", "name"), ("ids", "bioguide"))}
            rows.append(row | distinct | {"members": members})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_granule_mods(spark: SparkSession, path: str) -> DataFrame:
    """Flat metadata of the MODS files of single granules; a file that is no XML has only its name and ``parse_error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_granule_mods, GRANULE_MODS)


def package_ids(ids: DataFrame, key: str = "package") -> DataFrame:
    """Ids that have the shape of a daily package."""
    return ids.filter(F.col(key).rlike(r"\ACREC-\d{4}-\d{2}-\d{2}\z"))
