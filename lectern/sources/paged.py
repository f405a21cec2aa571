"""A paged JSON listing as a Spark data source: a partition for each collection and day, read by cursor inside tasks.

Register it once a session, then read it like any format:

    spark.dataSource.register(PagedListing)
    spark.read.format("lectern_paged").option("url", "https://host/{collection}/{day}?offset={cursor}").option("collections", "A,B") \\
        .option("first", "2024-01-01").option("last", "2024-01-31").load()

A page is an object with ``items`` (option ``items``) and the cursor of the next page (option ``next``; a whole URL or a cursor,
absent or null at the end). A cursor that comes twice fails the read: such a listing never ends. Transient failures (status
429 or 5xx, broken or slow connections) are retried with growing pauses, honouring ``Retry-After``; others fail at once. A day without
listing (404) has no rows. The key, sent as a header, is masked in all errors. A lost task reads its own day again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "collection string, day string, page int, place int, id string, modified string, item string"
RETRIES, PAUSE_S, MOST_PAUSE_S, TIMEOUT_S = 5, 0.5, 60.0, 60.0
FIRST_CURSOR = "*"


class ListingError(RuntimeError):
    """A listing that loops, is no JSON object or keeps failing."""


@dataclass
class DayOf(InputPartition):
    collection: str
    day: str


class PagedListing(DataSource):
    """Rows of SCHEMA; ``id`` and ``modified`` are the fields named by the options of the same names, ``item`` the whole object."""

    @classmethod
    def name(cls) -> str:
        return "lectern_paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:  # noqa: ARG002
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        need = {"url", "collections", "first", "last"} - set(options)
        if need:
            raise ValueError(f"options missing: {', '.join(sorted(need))}")
        self.url, self.collections = options["url"], [c.strip() for c in options["collections"].split(",") if c.strip()]
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.items, self.next = options.get("items", "items"), options.get("next", "next")
        self.id, self.modified = options.get("id", "id"), options.get("modified", "lastModified")
        self.key, self.key_header = options.get("key", ""), options.get("keyheader", "X-Api-Key")
        self.retries, self.pause = int(options.get("retries", RETRIES)), float(options.get("pause", PAUSE_S))

    def partitions(self) -> list[DayOf]:
        days = [(self.first + timedelta(days=k)).isoformat() for k in range((self.last - self.first).days + 1)]
        return [DayOf(c, d) for c in self.collections for d in days]

    def read(self, partition: DayOf) -> Iterator[tuple]:
        cursor, seen, page = FIRST_CURSOR, set(), 0
        while cursor is not None:
            if cursor in seen:
                raise ListingError(f"{partition.collection} {partition.day}: the cursor {self.masked(cursor)} comes again after {page} pages")
            seen.add(cursor)
            body = self.fetch(self.address(partition, cursor))
            if body is None:
                return
            for place, item in enumerate(body.get(self.items) or []):
                text = lambda k, item=item: None if item.get(k) is None else str(item[k])
                yield (partition.collection, partition.day, page, place, text(self.id), text(self.modified), json.dumps(item, sort_keys=True))
            cursor, page = body.get(self.next) or None, page + 1

    def address(self, partition: DayOf, cursor: str) -> str:
        if "://" in cursor:
            # A page may name the next one whole, but not send the key to another host.
            if urllib.parse.urlsplit(cursor)[:2] != urllib.parse.urlsplit(self.url)[:2]:
                raise ListingError(f"a page points to another host: {self.masked(cursor)}")
            return cursor
        quoted = {k: urllib.parse.quote(v, safe="*") for k, v in (("collection", partition.collection), ("day", partition.day), ("cursor", cursor))}
        return self.url.format(**quoted)

    def masked(self, text: str) -> str:
        return text.replace(self.key, "***") if self.key else text

    def fetch(self, url: str) -> dict | None:
        """The page, None if there is none."""
        request = urllib.request.Request(url, headers={self.key_header: self.key} if self.key else {})
        for attempt in range(self.retries + 1):
            wait = min(self.pause * 2**attempt, MOST_PAUSE_S)
            try:
                with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                    body = json.load(answer)
                break
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return None
                if error.code != 429 and error.code < 500 or attempt == self.retries:
                    raise ListingError(f"{self.masked(url)}: status {error.code} after {attempt + 1} attempts") from None
                after = error.headers.get("Retry-After", "")
                wait = min(float(after), MOST_PAUSE_S) if after.isdigit() else wait
            except (OSError, ValueError) as error:
                if isinstance(getattr(error, "reason", None), FileNotFoundError):
                    return None
                if attempt == self.retries:
                    raise ListingError(f"{self.masked(url)}: {self.masked(str(error))} after {attempt + 1} attempts") from None
            time.sleep(wait)
        if not isinstance(body, dict):
            raise ListingError(f"{self.masked(url)}: not an object")
        return body


def listed_once(listing: DataFrame) -> DataFrame:
    """One row an id: a listing that changes while it is read may show an item twice. The last modified, then the last shown, stays."""
    newest = F.max_by(F.struct(*[c for c in listing.columns if c != "id"]), F.struct(F.coalesce("modified", F.lit("")), "day", "page", "place", "collection"))
    return listing.filter(F.col("id").isNotNull()).groupBy("id").agg(newest.alias("r")).select("id", "r.*")
