"""Scalar domain functions: parties, chambers, congresses, dates, ids, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names of parties and chambers, first year, state names of speaker markers.
PARTY_CODES = {
    "D": ("D", "DEM", "DEMOCRAT", "DEMOCRATIC", "100"),
    "R": ("R", "REP", "REPUBLICAN", "GOP", "200"),
    "I": ("I", "IND", "INDEPENDENT", "ID", "II", "328"),
}
CHAMBER_CODES = {"house": ("H", "HOUSE"), "senate": ("S", "SENATE"), "extensions": ("E", "EXTENSIONS")}
FIRST_YEAR = 1789
BILL_TYPES = ("hr", "s")


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def _by_code(value: Column, codes: dict[str, tuple[str, ...]]) -> Column:
    key, out = F.upper(F.trim(value.cast("string"))), F.lit("other")
    for name, known in codes.items():
        out = F.when(key.isin(*known), name).otherwise(out)
    return out


def party_of(raw: Column) -> Column:
    """D, R, I or other, from a name or numeric code in any case."""
    return _by_code(raw, PARTY_CODES)


def other_major_party(party: Column) -> Column:
    return F.when(party == "D", "R").when(party == "R", "D")


def chamber_of(raw: Column) -> Column:
    return _by_code(raw, CHAMBER_CODES)


def congress_of_year(year: Column) -> Column:
    return (F.floor((year - FIRST_YEAR) / 2) + 1).cast("int")


def year_of_congress(congress: Column) -> Column:
    return (FIRST_YEAR + 2 * (congress - 1)).cast("int")


def congress_or_date(congress: Column, date: Column) -> Column:
    """The stated congress if positive, else from the date's year, else 0."""
    stated = congress.cast("string").try_cast("int")
    year = F.substring(date, 1, 4).try_cast("int")
    return F.coalesce(F.when(stated > 0, stated), congress_of_year(year), F.lit(0))


def iso_date(digits: Column) -> Column:
    """YYYYMMDD to YYYY-MM-DD; anything else unchanged."""
    return F.regexp_replace(digits, r"\A(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")


#: Closed year ranges of the sampling eras.
ERAS = ((1873, 1900), (1901, 1945), (1946, 1980), (1981, 1993), (1994, 2016), (2017, 2026))


def era_of(year: Column, eras=ERAS) -> Column:
    out = F.lit("outside")
    for lo, hi in eras:
        out = F.when(year.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def source_family(source: Column) -> Column:
    return F.when(F.startswith(source, F.lit("hein_")), "hein").otherwise(source)


def surname(name: Column) -> Column:
    """Before a comma, else the last word; upper case."""
    plain = F.trim(name)
    last = F.when(F.contains(plain, F.lit(",")), F.trim(F.substring_index(plain, ",", 1))).otherwise(F.element_at(F.split(plain, r"\s+"), -1))
    return F.upper(last)


def bill_id(congress: Column, kind: Column, number: Column) -> Column:
    """``congress-type-number``; raises on an unknown type or a number that is not positive."""
    key = F.lower(F.trim(kind))
    good = key.isin(*BILL_TYPES) & (congress > 0) & (number > 0)
    return F.when(good, F.concat_ws("-", congress.cast("string"), key, number.cast("string"))).otherwise(F.raise_error(F.lit("bad bill identity")))


def ordinal(n: Column) -> Column:
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    suffix = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def safe_id(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z0-9._-]+\z")


def without_key(url: Column) -> Column:
    """The url with the value of an ``api_key`` parameter masked."""
    return F.regexp_replace(url, r"(?i)([?&]api_key=)[^&#\s]*", "$1***")


def listing_time(raw: Column) -> Column:
    """``dd-MMM-yyyy HH:mm`` or ISO, as ISO seconds; null if neither."""
    at = F.coalesce(F.try_to_timestamp(raw, F.lit("dd-MMM-yyyy HH:mm")), F.try_to_timestamp(raw))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def is_newer(a: Column, b: Column) -> Column:
    """a is later than b in UTC; unparsable stamps count as newer if they differ."""
    return F.coalesce(F.try_to_timestamp(a) > F.try_to_timestamp(b), F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))


def passage(text: Column, centre: Column, chars: int = 1200) -> Column:
    """A slice of ``chars`` characters around an offset, kept inside the text."""
    start = F.greatest(F.lit(0), F.least(centre - chars // 2, F.length(text) - chars))
    return F.substring(text, start.cast("int") + 1, F.lit(chars))


def rate(count: Column, base: Column, scale: int = 1000) -> Column:
    """``scale * count / base``, 0.0 where the base is 0."""
    return F.coalesce(F.try_divide(count * F.lit(float(scale)), base), F.lit(0.0))


def hash_priority(*parts: Column) -> Column:
    """Unsigned 64-bit priority of the parts from SHA-256, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def content_fingerprint(text: Column, *identity: Column, at_least: int = 500) -> Column:
    """SHA-256 of NUL-joined identity and white-space-normalised text without page marks; '' below the length."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\[Page [^\]]*\]\]", " "), r"\s+", " "))
    return F.when(F.length(plain) >= at_least, F.sha2(F.concat_ws("\x00", *identity, plain), 256)).otherwise("")


def bill_url(base: str, congress: Column, kind: Column, number: Column) -> Column:
    """Public page of a bill below ``base``."""
    chamber = F.when(F.lower(kind) == "s", "senate-bill").otherwise("house-bill")
    return F.concat(F.lit(base.rstrip("/") + "/"), ordinal(congress), F.lit("-congress/"), chamber, F.lit("/"), number.cast("string"))


def newest_stamp(*stamps: Column) -> Column:
    """The latest of several times as UTC ISO seconds; unparsable ones are passed over (session zone UTC)."""
    parsed = F.array_max(F.array(*[F.try_to_timestamp(s) for s in stamps]))
    return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'")
