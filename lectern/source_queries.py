"""Queries of sources, sinks, state and large lexicons: the given tables are written in the form that a source reads, and read back.

They are registered with those of :mod:`lectern.queries`. What is written lies in the folder that all executors share.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import domain as dom
from lectern.functions.scoring import Scorer
from lectern.functions.sentiment import Valences, compound_sentiment
from lectern.operators import bills as bl
from lectern.operators import incremental as inc
from lectern.operators import members as mem
from lectern.operators import phrase_index as pi
from lectern.operators import resumable
from lectern.plans.parallelism import spread
from lectern.plans.scratch import application_root, stored
from lectern.queries import SCORES_SQL, SUMS_SQL, demo_scorer, query, table, turns
from lectern.schema import conform
from lectern.sources import archives, bill_status, buckets, delimited, observed, packages, staged, zone_map
from lectern.streaming import member_state


def scratch(spark: SparkSession, name: str) -> str:
    return f"{application_root(spark)}/{name}-{uuid.uuid4().hex}"


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def digits(c, n: int = 2):
    return F.lpad(c.cast("string"), n, "0")


DELIMITED_SQL = """
SELECT 'hein_daily:' || o_orderkey AS turn_id, 'hein_daily' AS source, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 10 = 0 THEN 'senate' WHEN o_orderkey % 3 = 0 THEN 'senate' ELSE 'house' END AS chamber,
  CASE WHEN o_orderkey % 7 = 0 THEN 'The SPEAKER' WHEN o_orderkey % 2 = 0 THEN 'Mr. C' || o_custkey ELSE 'Ann C' || o_custkey END AS speaker_name, o_custkey::VARCHAR AS speaker_id,
  CASE o_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END AS party, CASE WHEN o_orderkey % 5 = 0 THEN 'TX' ELSE 'NY' END AS state,
  CASE WHEN o_orderkey % 4 = 0 THEN 77 ELSE len(list_filter(string_split(o_orderpriority || ' | café ' || o_orderstatus, ' '), lambda x: x <> '')) END::BIGINT AS word_count,
  o_orderkey % 7 = 0 AS is_procedural, o_orderpriority || ' | café ' || o_orderstatus AS text FROM orders
"""


@query("delimited_turns", DELIMITED_SQL)
def delimited_turns(spark, sf):
    """Orders as speeches, descriptions (some twice: the last line counts) and a speaker map, in delimited latin-1 files; equal file numbers hold equal keys."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    n, key, cust = cores(spark), F.col("k").cast("string"), F.col("o_custkey").cast("string")
    blank = F.lit("")
    chamber = lambda first: F.when((F.col("k") % 10 == 0) & F.lit(not first), "S").when(F.col("k") % 10 == 0, "H").when(F.col("k") % 3 == 0, "S").otherwise("H")
    who = F.when(F.col("k") % 7 == 0, "The SPEAKER").when(F.col("k") % 2 == 0, F.concat(F.lit("Mr. C"), cust)).otherwise("")
    described = lambda first: F.concat_ws("|", key, chamber(first), F.date_format("o_orderdate", "yyyyMMdd"), blank, who, blank, blank, F.when(F.col("k") % 5 == 0, "").otherwise("NY"), *[blank] * 5, F.when(F.col("k") % 4 == 0, "77").otherwise(""))
    party = F.element_at(F.array(*map(F.lit, "DRI")), (F.col("o_custkey") % 3 + 1).cast("int"))
    lines = {
        "speeches": ("speech_id|speech", F.array(F.concat_ws("|", key, F.concat("o_orderpriority", F.lit(" | café "), "o_orderstatus")))),
        "descr": ("speech_id|chamber", F.array(described(True), described(False))),
        "speakers": ("speakerid|speech_id", F.array(F.concat_ws("|", cust, key, F.concat(F.lit("C"), cust), F.lit("Ann"), F.lit("H"), F.when(F.col("k") % 5 == 0, "TX").otherwise(""), F.lit("F"), party, F.lit("1")))),
    }
    paths = {}
    for name, (header, rows) in lines.items():
        paths[name] = scratch(spark, name)
        dealt = o.repartition(n, "k").sortWithinPartitions("k").select(F.explode(F.concat(F.array(F.lit(header)), rows)).alias("value"))  # headers wherever
        dealt.select(F.encode("value", "ISO-8859-1").alias("value")).select(F.col("value").cast("string")).write.text(paths[name])
    made = delimited.speech_turns(spark, paths["speeches"], paths["descr"], paths["speakers"], "daily")
    return made.select("turn_id", "source", "date", "chamber", "speaker_name", "speaker_id", "party", "state", "word_count", "is_procedural", "text")


@query("manifest_rows", """SELECT 'g' || g AS "granuleId", '2024-01-' || lpad((1 + g % 28)::VARCHAR, 2, '0') AS "dateIssued", min(event_id) >= 4000 AS backfilled
FROM (SELECT event_id % 4000 AS g, event_id FROM events WHERE event_id % 50 <> 7) GROUP BY g""")
def manifest_rows(spark, sf):
    """Events as manifest lines, some cut short and some backfilled again; one row a granule."""
    g = F.col("event_id") % 4000
    row = F.to_json(F.struct(F.concat(F.lit("g"), g.cast("string")).alias("granuleId"), F.concat(F.lit("2024-01-"), digits(1 + g % 28)).alias("dateIssued"), (F.col("event_id") >= 4000).alias("backfilled")))
    path = scratch(spark, "manifest")
    table(spark, sf, "events").select(F.when(F.col("event_id") % 50 == 7, F.substring(row, 1, 20)).otherwise(row).alias("value")).write.text(path)
    return packages.merge_manifests(packages.read_manifest(spark, path)).select("granuleId", "dateIssued", F.coalesce("backfilled", F.lit(False)).alias("backfilled"))


@query("listed_bills", """SELECT o_custkey, 118 AS congress, CASE WHEN o_orderkey % 2 = 0 THEN 'hr' ELSE 's' END AS bill_type, (o_orderkey + 1)::INTEGER AS bill_number, 'u' || o_orderkey AS url,
strftime(o_orderdate, '%Y-%m-%d') || 'T03:04:00' AS modified FROM orders""")
def listed_bills(spark, sf):
    """Directory listings, one of a customer's orders each, with files that are no bills between."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("BILLSTATUS-118"), F.when(k % 2 == 0, "hr").otherwise("s"), (k + 1).cast("string"), F.lit(".xml"))
    file = F.concat(F.lit("<file><name>"), name, F.lit("</name><link>u"), k.cast("string"), F.lit("</link><formattedLastModifiedTime>"), F.date_format("o_orderdate", "dd-MMM-yyyy"), F.lit(" 03:04</formattedLastModifiedTime></file><file><name>x.zip</name></file>"))
    xml = F.concat(F.lit("<data><files>"), F.array_join(F.collect_list(file), ""), F.lit("</files></data>"))
    listings = table(spark, sf, "orders").groupBy("o_custkey").agg(xml.alias("xml"))
    return listings.select("o_custkey", F.explode(bill_status.parse_listing(F.col("xml"))).alias("b")).select("o_custkey", "b.*")


@query("normalised_bills", """WITH b AS (SELECT *, (o_custkey + 1) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT '118-hr-' || n AS bill_id, 118::BIGINT AS congress, 'hr' AS bill_type, n AS bill_number, CASE o_orderkey % 3 WHEN 0 THEN 'senate' WHEN 1 THEN 'house' ELSE '' END AS origin_chamber,
o_orderstatus <> 'O' AS passed_any_chamber, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS became_law, o_orderkey FROM b WHERE k = 1""")
def normalised_bills(spark, sf):
    """A customer's orders as repeated rows of one bill, of which the last counts; numbers as text, chambers short and flags null."""
    k, n = F.col("o_orderkey"), (F.col("o_custkey") + 1).cast("string")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("118-hr-"), n).alias("bill_id"), F.lit("118").alias("congress"), F.lit("hr").alias("bill_type"), n.alias("bill_number"),
        F.when(k % 3 == 0, " S ").when(k % 3 == 1, "House").alias("origin_chamber"), F.when(F.col("o_orderstatus") != "O", True).alias("passed_any_chamber"),
        F.when((F.col("o_orderstatus") == "F") & (k % 2 == 0), True).alias("became_law"), k.alias("o_orderkey"),
    )
    return bl.normalized(rows, F.col("o_orderkey")).select("bill_id", "congress", "bill_type", "bill_number", "origin_chamber", "passed_any_chamber", "became_law", "o_orderkey")


@query("repaired_days", """SELECT 'B' || (user_id % 97) AS bioguide, strftime(ts, '%Y-%m-%d') AS date, CASE user_id % 2 WHEN 0 THEN 'house' ELSE 'senate' END AS chamber, count(*) AS turns FROM events GROUP BY ALL""")
def repaired_days(spark, sf):
    """A stored table that lacks late rows of its last days, repaired by recomputing the look-back window."""
    e = table(spark, sf, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    days = lambda rows: rows.groupBy(F.concat(F.lit("B"), (F.col("user_id") % 97).cast("string")).alias("bioguide"), "date", F.when(F.col("user_id") % 2 == 0, "house").otherwise("senate").alias("chamber")).agg(F.count(F.lit(1)).alias("turns"))
    newest = date.fromisoformat(e.agg(F.max("date")).first()[0])
    low, high = (d.isoformat() for d in inc.repair_window(newest, newest))
    late = F.col("date").between(low, high) & (F.col("event_id") % 3 == 0)
    return inc.merge_member_days(stored(days(e.filter(~late)), "days-before"), days(e.filter(F.col("date").between(low, high))))


@query("quoted_hits", """SELECT doc_id, (doc_id % 3 + 1)::BIGINT AS profanity_hits, (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS profanity_quoted_hits FROM documents""")
def quoted_hits(spark, sf):
    """Profanity that a speaker quotes is counted apart from what is spoken: the texts' lengths with both put in."""
    k = F.col("doc_id")
    quoted = F.when(k % 2 == 0, F.concat(F.lit(" he said ``a damn "), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 300), "[^0-9 ]", "x"), F.lit(" crap'' and ")))
    spoken = F.concat(F.coalesce(quoted, F.lit(" ")), F.regexp_replace(F.coalesce("text", F.lit("")), "[^0-9 ]", "y"), F.repeat(F.lit(" damn it "), (k % 3 + 1).cast("int")))
    rows = table(spark, sf, "documents").select("doc_id", spoken.alias("text"), F.lit("D").alias("party"))
    return mem.score_spoken(rows, Scorer.sample()).select("doc_id", "profanity_hits", "profanity_quoted_hits")


def _write_archives(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name, keys, lines in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    for key, text in zip(keys, lines, strict=True):
                        z.writestr(f"d/{key}.txt", text.encode("latin-1"))
                with system.open_output_stream(f"{inner}/{name}.zip") as out:
                    out.write(data.getvalue())
                yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


@query("archived_orders", "SELECT o_custkey % 20 AS archive, o_custkey AS member, count(*) AS lines, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def archived_orders(spark, sf):
    """Orders in ZIP archives, a member a customer, read back by range through the directory index."""
    root = scratch(spark, "archives")
    by_member = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.col("o_orderkey").cast("string"), F.lit("|café"))), "\r\n").alias("t"))
    packed = by_member.groupBy((F.col("o_custkey") % 20).cast("string").alias("name")).agg(F.collect_list("o_custkey").alias("k"), F.collect_list("t").alias("t"))
    system, inner = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    system.create_dir(inner, recursive=True)
    packed.mapInArrow(_write_archives(root), "name string").count()
    rows = archives.lines(archives.index(spark, root))
    number = lambda c: F.regexp_extract(c, r"(\d+)\.\w+\z", 1).cast("long")
    return rows.groupBy(number("archive").alias("archive"), number("member").alias("member")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.split_part("line", F.lit("|"), F.lit(1)).cast("long")).alias("keys"))


def _orders_by_month(spark, sf):
    """(zones of the orders' days, one file or more a month)."""
    path = scratch(spark, "by-month")
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rows.repartition(F.substring("day", 1, 7)).sortWithinPartitions("day").withColumn("month", F.substring("day", 1, 7)).write.partitionBy("month").parquet(path)
    return zone_map.refresh(spark, path, "day", scratch(spark, "zones"))


@query("zone_profile", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY ALL")
def zone_profile(spark, sf):
    """Rows and ranges of files from their footers alone."""
    files = zone_map.file_profile(_orders_by_month(spark, sf))
    return files.groupBy(F.regexp_extract("path", "month=([^/]*)/", 1).alias("month")).agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


@query("zone_missing_days", "SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderdate::DATE = l_shipdate::DATE)")
def zone_missing_days(spark, sf):
    """Days on which something shipped and nothing was ordered; only files whose range holds such a day are opened."""
    wanted = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return zone_map.missing_values(spark, _orders_by_month(spark, sf), "day", wanted, "day").values


@query("staged_orders", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def staged_orders(spark, sf):
    """Two published runs, of which the second replaced one partition, and a third that never was switched to."""
    root = scratch(spark, "staged")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    staged.publish(rows, root, "o_orderstatus")
    staged.publish(rows.filter("o_orderstatus = 'F'").withColumn("price", F.col("price") * 2), root, "o_orderstatus")
    staged.stage(rows.withColumn("price", F.lit(0.0)), root, "o_orderstatus")
    return staged.read(spark, root).select("o_orderkey", "o_orderstatus", "price")


@query("observed_counts", """WITH t AS (SELECT *, o_orderkey % 11 = 0 AS malformed, o_custkey % 13 = 0 AS rejected FROM orders), g AS (SELECT * FROM t WHERE NOT malformed AND NOT rejected)
SELECT count(*) AS rows, count_if(malformed) AS malformed, count_if(rejected AND NOT malformed) AS rejected, (SELECT count(*) FROM g) AS total_turns, (SELECT count_if(o_orderkey % 4 = 0) FROM g) AS procedural_turns,
(SELECT sum(o_custkey)::BIGINT FROM g) AS total_words, (SELECT count_if(o_orderkey % 4 <> 0 AND o_orderstatus <> 'P') FROM g) AS analysis_party_turns FROM t""")
def observed_counts(spark, sf):
    """Orders published as turns, with the counts that were taken in the pass that wrote them."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.cast("string").alias("turn_id"), F.lit(118).alias("congress"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("D").alias("party"), (k % 4 == 0).alias("is_procedural"), F.col("o_custkey").alias("word_count"), "o_orderkey", "o_custkey",
    )
    counts = observed.publish_observed(rows, scratch(spark, "observed"), malformed=k % 11 == 0, rejected=F.col("o_custkey") % 13 == 0, max_rejected=2**40)
    # The counts of a run are one row by nature.
    names = ("rows", "malformed", "rejected", "total_turns", "procedural_turns", "total_words", "analysis_party_turns")
    return spark.createDataFrame([tuple(counts[c] for c in names)], ", ".join(f"{c} long" for c in names))


@query("resumed_totals", f"WITH {SCORES_SQL}, {SUMS_SQL} SELECT * FROM spoken")
def resumed_totals(spark, sf):
    """Shard sums committed in waves; the first run stops after its first wave and the second does the rest."""
    t = turns(spark, sf).withColumn("shard", F.concat_ws(":", "source", F.col("congress").cast("string"))).withColumn("file", F.col("source")).withColumn("pos", F.col("doc_id"))
    current = t.select("shard").distinct().withColumn("files_key", F.col("shard"))
    path, scorer, rows = scratch(spark, "resumed"), demo_scorer(), t.count() // 2 + 1

    class _Stop(Exception):
        pass

    def stop(_wave):
        raise _Stop

    try:
        resumable.run(spark, path, current, t, scorer, "demo", rows, stop)
    except _Stop:
        pass
    return inc.totals(resumable.run(spark, path, current, t, scorer, "demo", rows))


@query("bucketed_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def bucketed_first(spark, sf):
    """Each customer's first order, from a bucketed table and without an exchange."""
    name = f"lectern_orders_{uuid.uuid4().hex}"
    buckets.write_buckets(table(spark, sf, "orders"), name, "o_custkey", cores(spark), path=scratch(spark, name))
    return buckets.first_of_each(spark, name, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_RUNS = r"[\p{L}\p{Nd}_]+"


def _runs_sql(name: str, id_: str) -> str:
    """Three consecutive runs with white space between, from place i."""
    return f"""SELECT {id_}, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase FROM (
      SELECT {id_}, regexp_extract_all(lower(coalesce(text, '')), '{_RUNS}') AS w, string_split_regex(lower(coalesce(text, '')), '{_RUNS}') AS g FROM {name}), unnest(range(1, len(w) - 1)) t(i)
      WHERE regexp_full_match(g[i + 1], '\\s+') AND regexp_full_match(g[i + 2], '\\s+')"""


@query("phrase_occurrences", f"""WITH p AS (SELECT DISTINCT phrase FROM ({_runs_sql("benchmark", "item_id")})), d AS ({_runs_sql("documents", "doc_id")})
SELECT doc_id, count(*) AS n, count(DISTINCT phrase) AS phrases FROM d JOIN p USING (phrase) GROUP BY doc_id""")
def phrase_occurrences(spark, sf):
    """Every three words in a row of the benchmark as a lexicon, found in the documents by the phrase index."""
    w, g = F.col("w"), F.col("g")
    split = table(spark, sf, "benchmark").select(pi.words_of(F.col("text")).alias("w"), F.split(F.lower(F.coalesce("text", F.lit(""))), pi.WORD, -1).alias("g"))
    free = lambda i: F.get(g, i).rlike(r"\A\s+\z")
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 3), lambda i: (i >= 0) & (F.size(w) >= 3) & free(i + 1) & free(i + 2))
    threes = split.filter(F.size(w) >= 3).select(F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, 3))).alias("three")).distinct()
    rows = threes.select(
        F.lit("benchmark").alias("lexicon"), F.xxhash64("three").alias("phrase"), F.lit(0).alias("priority"), F.lit(3).alias("size"),
        F.transform("three", lambda x: F.array(x)).alias("forms"), F.array(F.lit(" "), F.lit(" ")).alias("gaps"),
    )
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    index = pi.index_phrases(spark, rows.withColumn("phrase", F.pmod("phrase", F.lit(2**31 - 1)).cast("int")), docs)
    found = pi.matches(docs, index)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("found").alias("phrases"))


VALENCES = Valences({"and": 1.5, "is": -1.2, "on": 2.0, "en": -0.8, "der": 1.1, "de": -2.2}, {"the": 1, "of": -1}, frozenset({"in", "not"}))


def _sentiment_sql() -> str:
    value = "CASE low " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in VALENCES.words.items()) + " END"
    degree = "CASE low " + " ".join(f"WHEN '{w}' THEN {d} * 0.293" for w, d in VALENCES.degrees.items()) + " END"
    negates = f"(low IN ({', '.join(repr(n) for n in sorted(VALENCES.negators))}) OR ends_with(low, 'n''t'))"
    marks = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
    steps = []
    for k, near in enumerate((1.0, 0.95, 0.9), 1):
        before = {c: f"lag({c}, {k}) OVER w" for c in ("low", "value", "degree", "negates", "loud")}
        sign = f"CASE WHEN v{k - 1} > 0 THEN 1.0 ELSE -1.0 END"
        push = f"(coalesce({before['degree']}, 0) + CASE WHEN {before['degree']} IS NOT NULL AND {before['loud']} AND mixed THEN 0.733 ELSE 0 END) * {sign} * {near}"
        steps.append(f"s{k} AS (SELECT *, CASE WHEN {before['low']} IS NULL OR {before['value']} IS NOT NULL THEN v{k - 1} ELSE (v{k - 1} + {push}) * CASE WHEN {before['negates']} THEN -0.74 ELSE 1 END END AS v{k} FROM s{k - 1} WINDOW w AS (PARTITION BY doc_id, k ORDER BY i))")
    return f"""WITH a AS (SELECT doc_id, source, lang, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
b AS (SELECT doc_id, source, lang, k, parts[k] AS s FROM a, unnest(range(1, len(parts) + 1)) t(k) WHERE regexp_matches(parts[k], '\\S')),
c AS (SELECT doc_id, k, i, CASE WHEN length(trim(x[i], {marks})) > 2 THEN trim(x[i], {marks}) ELSE x[i] END AS word FROM (SELECT doc_id, k, regexp_extract_all(s, '\\S+') AS x FROM b), unnest(range(1, len(x) + 1)) t(i)),
d AS (SELECT doc_id, k, i, lower(word) AS low, upper(word) = word AND lower(word) <> word AS loud FROM c),
e AS (SELECT *, {value} AS value, {degree} AS degree, {negates} AS negates, count_if(loud) OVER p BETWEEN 1 AND count(*) OVER p - 1 AS mixed, min(CASE WHEN low = 'but' THEN i END) OVER p AS but FROM d WINDOW p AS (PARTITION BY doc_id, k)),
s0 AS (SELECT *, value + CASE WHEN loud AND mixed THEN CASE WHEN value > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END AS v0 FROM e),
{", ".join(steps)},
f AS (SELECT doc_id, k, coalesce(v3 * CASE WHEN but IS NULL OR i = but THEN 1 WHEN i < but THEN 0.5 ELSE 1.5 END, 0)::DOUBLE AS v FROM s3),
g AS (SELECT doc_id, k, sum(v) AS plain, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS up, coalesce(sum(1 - v) FILTER (WHERE v < 0), 0) AS down, count_if(v = 0) AS neutral FROM f GROUP BY ALL),
h AS (SELECT *, least(length(s) - length(replace(s, '!', '')), 4) * 0.292 + CASE WHEN length(s) - length(replace(s, '?', '')) <= 1 THEN 0 WHEN length(s) - length(replace(s, '?', '')) <= 3 THEN (length(s) - length(replace(s, '?', ''))) * 0.18 ELSE 0.96 END AS push FROM b JOIN g USING (doc_id, k)),
j AS (SELECT *, CASE WHEN plain > 0 THEN plain + push WHEN plain < 0 THEN plain - push ELSE 0 END AS raised, CASE WHEN up > down THEN up + push ELSE up END AS up_, CASE WHEN down > up THEN down + push ELSE down END AS down_ FROM h),
m AS (SELECT source, lang, raised / sqrt(raised * raised + 15) AS value, CASE WHEN up_ + down_ + neutral = 0 THEN 0 ELSE down_ / (up_ + down_ + neutral) END AS below FROM j)
SELECT source, lang, count(*) AS sentences, round(sum(value) / count(*), 9) AS mean_sentiment, round(sum(below) / count(*), 9) AS mean_neg_share FROM m GROUP BY ALL"""


@query("sentiment_means", _sentiment_sql())
def sentiment_means(spark, sf):
    """Compound sentiment of every sentence, as sentence-weighted means by source and language."""
    docs = spread(table(spark, sf, "documents").select("source", "lang", "text"))
    scored = docs.withColumn("_s", compound_sentiment(VALENCES)(F.col("text"))).select("source", "lang", "_s.*")
    weight = F.col("n_sentences")
    sums = scored.groupBy("source", "lang").agg(F.sum(weight).alias("sentences"), *(F.sum(F.col(c) * weight).alias(c) for c in ("sentiment", "neg_share"))).filter("sentences > 0")
    return sums.select("source", "lang", "sentences", F.round(F.col("sentiment") / F.col("sentences"), 9).alias("mean_sentiment"), F.round(F.col("neg_share") / F.col("sentences"), 9).alias("mean_neg_share"))


@query("streamed_member_days", f"""WITH {SCORES_SQL}, s AS (SELECT * FROM turns JOIN scores USING (doc_id) WHERE NOT is_procedural),
w AS (SELECT bioguide, arg_max(party, date || lpad(doc_id::VARCHAR, 12, '0')) AS party FROM s GROUP BY bioguide)
SELECT s.bioguide, date, chamber, w.party, arg_max(congress, doc_id) AS congress, count(*)::BIGINT AS turns, sum(n_words)::BIGINT AS words, sum(profanity_hits)::BIGINT AS profanity_hits,
  sum(hostility_hits)::BIGINT AS hostility_hits, sum(misconduct_hits)::BIGINT AS misconduct_hits FROM s JOIN w USING (bioguide) GROUP BY s.bioguide, date, chamber, w.party""")
def streamed_member_days(spark, sf):
    """Documents as turn files, read as a stream with keyed state."""
    src, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    conform(turns(spark, sf).withColumn("turn_id", F.lpad("turn_id", 12, "0")).withColumn("speaker_id", F.lit(""))).write.parquet(src)
    member_state.start(spark, src, out, scratch(spark, "stream-state"), demo_scorer(), partitions=cores(spark)).awaitTermination()
    return member_state.member_days(spark, out).select("bioguide", "date", "chamber", "party", "congress", "turns", "words", *mem.HITS)


@query("domain_values", """WITH o AS (SELECT *, o_orderkey AS k, 1870 + o_orderkey % 160 AS y FROM orders)
SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'senate' WHEN 2 THEN 'extensions' ELSE 'other' END AS chamber,
  CASE k % 3 WHEN 0 THEN 118 ELSE (year(o_orderdate) - 1789) // 2 + 1 END::INTEGER AS congress, strftime(o_orderdate, '%Y-%m-%d') AS iso,
  CASE WHEN y BETWEEN 1873 AND 1900 THEN '1873-1900' WHEN y BETWEEN 1901 AND 1945 THEN '1901-1945' WHEN y BETWEEN 1946 AND 1980 THEN '1946-1980' WHEN y BETWEEN 1981 AND 1993 THEN '1981-1993'
       WHEN y BETWEEN 1994 AND 2016 THEN '1994-2016' WHEN y BETWEEN 2017 AND 2026 THEN '2017-2026' ELSE 'outside' END AS era,
  CASE WHEN k % 2 = 0 THEN 'hein' ELSE 'govinfo' END AS family, CASE WHEN k % 2 = 0 THEN 'DOE' || o_custkey ELSE 'ROE' || o_custkey END AS surname,
  'http://h/x?a=1&api_key=***&b=' || k AS url, k || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  'https://h/118th-congress/' || CASE WHEN k % 2 = 0 THEN 'senate-bill/' ELSE 'house-bill/' END || k AS page, k % 5 <> 0 AS safe,
  strftime(greatest(o_orderdate, TIMESTAMP '1998-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM o""")
def domain_values(spark, sf):
    """Chambers, congresses, dates, eras, families, surnames, links and stamps from strings that are made of orders."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey", dom.chamber_of(pick(4, "H", " senate", "e", "joint")).alias("chamber"), dom.congress_or_date(pick(3, "118", "0", "none"), day).alias("congress"),
        dom.iso_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("iso"), dom.era_of(1870 + k % 160).alias("era"), dom.source_family(pick(2, "hein_bound", "govinfo")).alias("family"),
        dom.surname(F.when(k % 2 == 0, F.concat(F.lit(" Doe"), cust, F.lit(", Jane"))).otherwise(F.concat(F.lit("Ann van  Roe"), cust))).alias("surname"),
        dom.without_key(F.concat(F.lit("http://h/x?a=1&api_key=s3cret"), cust, F.lit("&b="), k.cast("string"))).alias("url"), dom.ordinal(k).alias("ordinal"),
        dom.bill_url("https://h/", F.lit(118), pick(2, "S", "hr"), k).alias("page"), dom.safe_id(F.concat(F.lit("CREC-"), k.cast("string"), F.when(k % 5 == 0, "/..").otherwise(""))).alias("safe"),
        dom.newest_stamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("no date"), F.lit("1998-01-01T00:00:00Z")).alias("newest"),
    )


@query("passages", """SELECT doc_id, substr(t, greatest(0, least(c - 30, length(t) - 60)) + 1, 60) AS passage, sha256(substr(t, greatest(0, least(c - 30, length(t) - 60)) + 1, 60)) AS passage_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, (doc_id * 37) % greatest(1, length(coalesce(text, ''))) AS c FROM documents)""")
def passages(spark, sf):
    """Sixty characters around a place of each text, kept inside it."""
    text = F.coalesce("text", F.lit(""))
    made = dom.passage(text, ((F.col("doc_id") * 37) % F.greatest(F.lit(1), F.length(text))).cast("int"), 60)
    return table(spark, sf, "documents").select("doc_id", made.alias("passage"), F.sha2(made, 256).alias("passage_sha256"))


@query("shards_of_files", """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'govinfo:' || o_custkey % 20 ELSE 'file:hein_daily_' || o_custkey % 20 END AS shard, count(*) AS files FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def shards_of_files(spark, sf):
    """Files that may share turn ids make one shard."""
    c = F.col("o_custkey")
    name = F.concat(F.when(c % 3 == 0, F.lit("/d/govinfo_bulk_")).otherwise(F.lit("/d/hein_daily_")), (c % 20).cast("string"), F.lit(".parquet"))
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(inc.shard_of(name).alias("shard")).agg(F.count(F.lit(1)).alias("files"))
