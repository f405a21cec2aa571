"""The paged source on recorded pages, from files and from a server that fails now and then."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.sources.paged import PagedListing, listed_once


def record(folder, collection, day, pages):
    """One file a page, named by its cursor."""
    for cursor, body in pages.items():
        at = folder / collection / day
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{cursor}.json").write_text(json.dumps(body))


def load(spark, url, **options):
    spark.dataSource.register(PagedListing)
    base = {"url": url, "collections": "AA, BB", "first": "2024-02-28", "last": "2024-03-01", "pause": "0.01"}
    return spark.read.format("lectern_paged").options(**(base | options)).load()


def item(k, modified="2024-03-01"):
    return {"id": f"p{k}", "lastModified": modified, "title": "é"}


@pytest.fixture
def pages(tmp_path):
    record(tmp_path, "AA", "2024-02-28", {"*": {"items": [item(1), item(2)], "next": "c2"}, "c2": {"items": [], "next": "c3"}, "c3": {"items": [item(3)], "next": None}})
    record(tmp_path, "AA", "2024-02-29", {"*": {"items": [item(2, "2024-03-02"), {"title": "no id"}]}})
    record(tmp_path, "BB", "2024-03-01", {"*": {"items": None}})
    return tmp_path


def test_recorded_pages_are_read_by_collection_day_and_cursor(spark, pages):
    rows = load(spark, f"file://{pages}/{{collection}}/{{day}}/{{cursor}}.json")
    assert rows.rdd.getNumPartitions() == 6
    got = sorted((r["day"], r["page"], r["place"], r["id"] or "") for r in rows.collect())
    assert got == [("2024-02-28", 0, 0, "p1"), ("2024-02-28", 0, 1, "p2"), ("2024-02-28", 2, 0, "p3"), ("2024-02-29", 0, 0, "p2"), ("2024-02-29", 0, 1, "")]
    once = {r["id"]: (r["modified"], json.loads(r["item"])["title"]) for r in listed_once(rows).collect()}
    assert once == {"p1": ("2024-03-01", "é"), "p2": ("2024-03-02", "é"), "p3": ("2024-03-01", "é")}
    assert load(spark, "file:///nowhere/{cursor}").count() == 0


def test_loops_and_pages_that_are_none_fail(spark, tmp_path):
    record(tmp_path, "AA", "2024-02-28", {"*": {"items": [item(1)], "next": "c2"}, "c2": {"items": [item(2)], "next": "*"}})
    url = f"file://{tmp_path}/{{collection}}/{{day}}/{{cursor}}.json"
    with pytest.raises(PySparkException, match="comes again after 2 pages"):
        load(spark, url).collect()
    record(tmp_path, "AA", "2024-02-28", {"*": ["a", "list"]})
    with pytest.raises(PySparkException, match="not an object"):
        load(spark, url).collect()
    record(tmp_path, "AA", "2024-02-28", {"*": {"items": [], "next": "https://elsewhere/x"}})
    with pytest.raises(PySparkException, match="another host"):
        load(spark, url).collect()
    with pytest.raises(PySparkException, match="options missing: last"):
        spark.read.format("lectern_paged").options(url="x", collections="AA", first="2024-01-01").load().collect()


@pytest.fixture
def server(pages):
    tries, keys = Counter(), set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            tries[self.path] += 1
            keys.add(self.headers.get("X-Api-Key"))
            file = pages / f"{self.path.strip('/')}.json"
            if "refused" in self.path or (file.exists() and tries[self.path] < 3):
                self.send_response(403 if "refused" in self.path else 503 if tries[self.path] == 1 else 429)
                self.send_header("Retry-After", "0")
                self.end_headers()
            elif not file.exists():
                self.send_error(404)
            else:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(file.read_bytes())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", tries, keys
    http.shutdown()


def test_transient_failures_are_retried_and_the_key_is_masked(spark, server):
    base, tries, keys = server
    rows = load(spark, base + "/{collection}/{day}/{cursor}", key="s3cret")
    assert rows.agg(F.count("id")).first()[0] == 4 and keys == {"s3cret"}
    assert tries["/AA/2024-02-28/c3"] == 3 and tries["/BB/2024-02-28/*"] == 1
    with pytest.raises(PySparkException) as error:
        load(spark, base + "/refused/s3cret/{cursor}", key="s3cret").collect()
    assert "status 403 after 1 attempts" in str(error.value) and "/refused/***" in str(error.value)
    tries.clear()
    with pytest.raises(PySparkException, match="after 2 attempts"):
        load(spark, base + "/{collection}/{day}/{cursor}", retries="1").collect()
