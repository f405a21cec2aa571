"""Registry of the engine's queries over the star-schema tables, each with the SQL of the same rows.

The tables hold no proceedings, so turns are derived from ``documents``, member days from ``events``, bills from
``orders`` and ``lineitem``, by expressions that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import domain as dom
from lectern.functions import text as tx
from lectern.functions.lexicon import Lexicon
from lectern.functions.scoring import SCORES, Scorer, score_turns
from lectern.operators import agreement as agr
from lectern.operators import bills as bl
from lectern.operators import calibration as cal
from lectern.operators import coverage as cov
from lectern.operators import dedup as dd
from lectern.operators import incremental as inc
from lectern.operators import members as mem
from lectern.operators import metrics as met
from lectern.operators import reports as rep
from lectern.operators import sampling as smp
from lectern.operators import segments as seg
from lectern.operators import series as ser
from lectern.plans.parallelism import spread
from lectern.score_sql import TOKEN_SQL, contexts, one_of, quoted, raw_and_rates, score_ctes, spans, sums, unnegated, windows
from lectern.sources.packages import html_text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TURNS_SQL = r"""
turns AS (
  SELECT doc_id, doc_id::VARCHAR AS turn_id,
         CASE doc_id % 3 WHEN 0 THEN 'govinfo' WHEN 1 THEN 'hein_bound' ELSE 'hein_daily' END AS source,
         strftime(DATE '1995-01-01' + (doc_id % 8000)::INTEGER, '%Y-%m-%d') AS date, (103 + doc_id % 17)::INTEGER AS congress,
         CASE doc_id % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'senate' WHEN 2 THEN 'extensions' ELSE 'other' END AS chamber,
         CASE (doc_id // 4) % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'I' ELSE 'other' END AS party,
         'B' || (doc_id % 97) AS bioguide, n_chars // 6 AS word_count, doc_id % 10 = 0 AS is_procedural, text
  FROM documents)"""
SCORED_SQL = rf"""{TURNS_SQL},
tok AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_SQL}') AS t, lower(coalesce(text, '')) AS low FROM turns),
scored AS (SELECT *, len(t) AS n_words, len(list_filter(t, lambda x: x IN ('the', 'thing', 'things', 'thinged', 'thinging'))) AS single_hits,
           len(regexp_extract_all(low, '\band\s+in\b')) AS phrase_hits FROM tok)"""
DAILY_SQL = """
daily AS (
  SELECT 'B' || (user_id % 97) AS bioguide, strftime(ts, '%Y-%m-%d') AS date,
         CASE user_id % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'senate' ELSE 'extensions' END AS chamber,
         min(CASE (user_id % 97) % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END) AS party, 118 AS congress,
         count(*)::BIGINT AS turns, sum(event_id % 500)::BIGINT AS words, count_if(event_type = 'purchase')::BIGINT AS profanity_hits,
         count_if(event_type = 'click')::BIGINT AS hostility_hits, count_if(event_type = 'view')::BIGINT AS misconduct_hits
  FROM events GROUP BY ALL)"""
BILLS_SQL = """
bills AS (
  SELECT 'B' || (o_custkey % 97) AS sponsor_bioguide, o_orderkey + 1 AS bill_number, CASE (o_orderkey + 1) % 2 WHEN 0 THEN 'hr' ELSE 's' END AS bill_type,
         118 AS congress, '118-' || CASE (o_orderkey + 1) % 2 WHEN 0 THEN 'hr' ELSE 's' END || '-' || (o_orderkey + 1) AS bill_id,
         o_orderstatus <> 'O' AS passed_any_chamber, o_orderstatus = 'F' AND (o_orderkey + 1) % 5 = 0 AS became_law,
         strftime(o_orderdate, '%Y-%m-%d') AS introduced_date, o_totalprice FROM orders)"""


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    d, i = spread(table(spark, sf, "documents")), F.col("doc_id")
    pick = lambda x, n, names: F.element_at(F.array(*map(F.lit, names)), (x % n + 1).cast("int"))
    return d.select(
        "doc_id", i.cast("string").alias("turn_id"), pick(i, 3, ["govinfo", "hein_bound", "hein_daily"]).alias("source"),
        F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (i % 8000).cast("int")), "yyyy-MM-dd").alias("date"), (103 + i % 17).cast("int").alias("congress"),
        pick(i, 4, ["house", "senate", "extensions", "other"]).alias("chamber"), pick(F.floor(i / 4), 4, ["D", "R", "I", "other"]).alias("party"),
        F.concat(F.lit("B"), (i % 97).cast("string")).alias("bioguide"), F.floor(F.col("n_chars") / 6).alias("word_count"), (i % 10 == 0).alias("is_procedural"),
        F.lit("").alias("speaker_name"), F.lit("").alias("state"), "text",
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    e, u = table(spark, sf, "events"), F.col("user_id")
    pick = lambda x, names: F.element_at(F.array(*map(F.lit, names)), (x % 3 + 1).cast("int"))
    kind = lambda t: F.count_if(F.col("event_type") == t)
    return e.groupBy(
        F.concat(F.lit("B"), (u % 97).cast("string")).alias("bioguide"), F.date_format("ts", "yyyy-MM-dd").alias("date"), pick(u, ["house", "senate", "extensions"]).alias("chamber")
    ).agg(
        F.min(pick(u % 97, ["D", "R", "I"])).alias("party"), F.lit(118).alias("congress"), F.lit("").alias("speaker_name"), F.lit("").alias("state"), F.count(F.lit(1)).alias("turns"),
        F.sum(F.col("event_id") % 500).alias("words"), kind("purchase").alias("profanity_hits"), F.lit(0).cast("long").alias("profanity_quoted_hits"), kind("click").alias("hostility_hits"), kind("view").alias("misconduct_hits"),
    )


def bills(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") + 1
    kind = F.when(k % 2 == 0, "hr").otherwise("s")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("B"), (F.col("o_custkey") % 97).cast("string")).alias("sponsor_bioguide"), F.lit("").alias("sponsor_name"), F.lit("").alias("sponsor_party"), F.lit("").alias("sponsor_state"),
        F.lit("house").alias("origin_chamber"), k.alias("bill_number"), kind.alias("bill_type"), F.lit(118).alias("congress"), dom.bill_id(F.lit(118), kind, k).alias("bill_id"),
        (F.col("o_orderstatus") != "O").alias("passed_any_chamber"), ((F.col("o_orderstatus") == "F") & (k % 5 == 0)).alias("became_law"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("introduced_date"), "o_totalprice",
    )


#: Terms that occur in the tables.
DEMO = Lexicon.compile(["the", "thing", "of the", "and in"])


def demo_scorer() -> Scorer:
    terms = {"courtesy": ["the thing"], "gratitude": ["of the"], "cooperation": ["and"], "hostility": ["edth", "in the"], "misconduct": ["thing", "se"], "labels": ["ing"], "idioms": ["to the", "the other"]}
    return Scorer.compile(terms, ["er\tmild", "on\tstrong"], ["in"])


def hits(spark, sf):
    d = turns(spark, sf).withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("tok", tx.tokens(F.col("low")))
    return d.withColumn("n_words", F.size("tok").cast("long"))


@query("token_count", rf"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_SQL}'))::BIGINT AS n_words FROM documents")
def token_count(spark, sf):
    return hits(spark, sf).select("doc_id", "n_words")


# 'of the' holds one lexicon word, so its hit adds one and takes one away; 'and in' holds none.
@query("lex_count", f"WITH {SCORED_SQL} SELECT doc_id, (single_hits + phrase_hits)::BIGINT AS hits FROM scored")
def lex_count(spark, sf):
    return hits(spark, sf).select("doc_id", tx.count_hits(DEMO, F.col("low"), F.col("tok")).cast("long").alias("hits"))


@query("lex_count_excluding", rf"WITH {SCORED_SQL} SELECT doc_id, greatest(0, single_hits + phrase_hits - len(regexp_extract_all(low, '\bthe\s+a[a-z]*\b')))::BIGINT AS hits FROM scored")
def lex_count_excluding(spark, sf):
    return hits(spark, sf).select("doc_id", tx.count_hits_excluding(DEMO, F.col("low"), F.col("tok"), r"\bthe\s+a[a-z]*\b").cast("long").alias("hits"))


@query("rate_per_1k", f"WITH {SCORED_SQL} SELECT party, sum(n_words)::BIGINT AS words, sum(single_hits + phrase_hits)::BIGINT AS hits, CASE WHEN sum(n_words) = 0 THEN 0.0 ELSE sum(single_hits + phrase_hits) * 1000.0 / sum(n_words) END AS rate FROM scored GROUP BY party")
def rate_per_1k(spark, sf):
    d = hits(spark, sf).withColumn("h", tx.count_hits(DEMO, F.col("low"), F.col("tok")))
    g = d.groupBy("party").agg(F.sum("n_words").alias("words"), F.sum("h").alias("hits"))
    return g.withColumn("rate", dom.rate(F.col("hits"), F.col("words")))


def scored_table(spark, sf):
    d = met.substantive(met.with_groups(hits(spark, sf))).withColumn("h", tx.count_hits(DEMO, F.col("low"), F.col("tok")))
    g = d.groupBy(*met.GROUP).agg(F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"), F.sum("h").cast("long").alias("hits"))
    return g.withColumn("year", dom.year_of_congress(F.col("congress"))).withColumn("rate", dom.rate(F.col("hits"), F.col("words")))


METRIC_SQL = f"""WITH {SCORED_SQL},
m AS (SELECT source, congress, chamber, party, count(*)::BIGINT AS turns, sum(n_words)::BIGINT AS words, sum(single_hits + phrase_hits)::BIGINT AS hits, (1789 + 2 * (congress - 1))::INTEGER AS year,
             CASE WHEN sum(n_words) = 0 THEN 0.0 ELSE sum(single_hits + phrase_hits) * 1000.0 / sum(n_words) END AS rate FROM scored WHERE NOT is_procedural GROUP BY ALL)"""


SCORES_SQL = f"{TURNS_SQL}, {score_ctes(demo_scorer())}"
SUMS_SQL = f"""spoken AS (SELECT source, congress, chamber, party, count(*)::BIGINT AS turns, sum(n_words)::BIGINT AS words, {sums()} FROM turns JOIN scores USING (doc_id) WHERE NOT is_procedural GROUP BY ALL)"""


@query("metric_table", f"WITH {SCORES_SQL}, {SUMS_SQL}, a AS (SELECT congress, party, sum(turns)::BIGINT AS turns, sum(words)::BIGINT AS words, {sums()} FROM spoken GROUP BY ALL) SELECT 'all' AS source, congress, (1789 + 2 * (congress - 1))::INTEGER AS year, 'all' AS chamber, party, turns, words, {raw_and_rates()} FROM a")
def metric_table(spark, sf):
    """The metric table of partial sums that are merged over sources and chambers first."""
    scored = score_turns(met.substantive(met.with_groups(turns(spark, sf))), demo_scorer())
    merged = met.merge_sums(met.sum_scores(scored), ("congress", "party"))
    return met.metric_table(merged.withColumn("source", F.lit("all")).withColumn("chamber", F.lit("all")))


@query("primary_source_pick", f"""{METRIC_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY congress, chamber, party ORDER BY source) AS k FROM m
  WHERE CASE WHEN congress <= 114 THEN starts_with(source, 'hein') ELSE source = 'govinfo' END) SELECT * EXCLUDE (k) FROM l WHERE k = 1""")
def primary_source_pick(spark, sf):
    return met.primary_source(scored_table(spark, sf))


@query("source_ranges", f"{METRIC_SQL} SELECT source, min(congress) AS min_congress, max(congress) AS max_congress, min(year) AS min_year, max(year) AS max_year, count(*) AS rows FROM m GROUP BY source")
def source_ranges(spark, sf):
    return met.source_ranges(scored_table(spark, sf))


@query("score_vector", f"WITH {SCORES_SQL} SELECT * FROM scores")
def score_vector(spark, sf):
    """All nineteen scores with a lexicon that occurs."""
    return score_turns(turns(spark, sf), demo_scorer()).select("doc_id", "n_words", *SCORES)


@query("full_metric_table", f"WITH {SCORES_SQL}, {SUMS_SQL} SELECT source, congress, (1789 + 2 * (congress - 1))::INTEGER AS year, chamber, party, turns, words, {raw_and_rates()} FROM spoken")
def full_metric_table(spark, sf):
    scored = score_turns(met.substantive(met.with_groups(turns(spark, sf))), demo_scorer())
    return met.metric_table(met.sum_scores(scored))


@query("turn_coverage", f"""WITH {TURNS_SQL}, c AS (SELECT source, congress, (1789 + 2 * (congress - 1))::INTEGER AS year, chamber, count(*)::BIGINT AS total_turns, sum(word_count)::BIGINT AS total_words,
  count_if(is_procedural)::BIGINT AS procedural_turns, coalesce(sum(word_count) FILTER (WHERE is_procedural), 0)::BIGINT AS procedural_words,
  count_if(NOT is_procedural)::BIGINT AS nonprocedural_turns, coalesce(sum(word_count) FILTER (WHERE NOT is_procedural), 0)::BIGINT AS nonprocedural_words,
  count_if(NOT is_procedural AND party IN ('D', 'R', 'I'))::BIGINT AS analysis_party_turns, coalesce(sum(word_count) FILTER (WHERE NOT is_procedural AND party IN ('D', 'R', 'I')), 0)::BIGINT AS analysis_party_words
  FROM turns GROUP BY ALL)
SELECT *, CASE WHEN nonprocedural_turns = 0 THEN 0.0 ELSE analysis_party_turns * 1.0 / nonprocedural_turns END::DOUBLE AS party_turn_share,
  CASE WHEN nonprocedural_words = 0 THEN 0.0 ELSE analysis_party_words * 1.0 / nonprocedural_words END::DOUBLE AS party_word_share FROM c""")
def turn_coverage(spark, sf):
    return met.coverage(turns(spark, sf))


@query("dedup_first_wins", """WITH d AS (SELECT doc_id % 700 AS turn_id, CASE WHEN doc_id >= 700 THEN 1 ELSE 0 END AS rank, doc_id FROM documents)
SELECT turn_id::VARCHAR AS turn_id, rank::INTEGER AS rank, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY rank, doc_id) = 1""")
def dedup_first_wins(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select((i % 700).cast("string").alias("turn_id"), (i >= 700).cast("int").alias("rank"), "doc_id")
    return dd.first_wins(d, F.col("rank"), F.col("doc_id"))


@query("dedup_fingerprint", r"""WITH d AS (SELECT doc_id, source, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS p FROM documents),
f AS (SELECT doc_id, source, CASE WHEN length(p) >= 500 THEN sha256(source || chr(0) || p) ELSE '' END AS fp FROM d)
SELECT doc_id, source FROM f QUALIFY fp = '' OR row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) = 1""")
def dedup_fingerprint(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    kept = dd.drop_repeated_content(d, "source", dom.content_fingerprint(F.coalesce("text", F.lit("")), F.col("source")), [F.col("doc_id")])
    return kept.select("doc_id", "source")


@query("dedup_prefer_flag", """SELECT user_id, event_id, event_type = 'view' AS backfilled FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view')::INTEGER, event_id) = 1""")
def dedup_prefer_flag(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("backfilled"))
    return dd.prefer_unflagged(e, "user_id", "backfilled", [F.col("event_id")])


@query("segment_turns", r"""WITH p AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\bOf\b') AS parts FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(parts))) AS i, len(parts) AS n, parts FROM p)
SELECT doc_id, (CASE WHEN trim(parts[1], E' \t\n\r\f\v') <> '' OR n = 1 THEN i ELSE i - 1 END)::INTEGER AS i, CASE WHEN i = 0 THEN '' ELSE 'Of' END AS marker, trim(parts[i + 1], E' \t\n\r\f\v') AS body
FROM e WHERE trim(parts[i + 1], E' \t\n\r\f\v') <> ''""")
def segment_turns(spark, sf):
    d = spread(table(spark, sf, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The word boundary of the SQL's engine knows ASCII only and Java's depends on its version, so it is spelled out.
    marker = r"(?<![0-9A-Za-z_])(Of)(?![0-9A-Za-z_])"
    rows = d.select("doc_id", F.posexplode(seg.segments(F.col("text"), marker)).alias("i", "s"))
    return rows.select("doc_id", "i", "s.marker", "s.body").filter("body <> ''")


@query("html_text")
def html_text_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_text(F.coalesce("html", F.lit(""))).alias("text"))


@query("mask_quotes", r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?s)the(.{0,100}?)of', 1) AS inner_texts, regexp_extract_all(text, '(?s)the.{0,100}?of') AS found, string_split_regex(text, '(?s)the.{0,100}?of') AS gaps FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, sha256(coalesce(list_reduce(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(repeat(' ', length(found[i])), '')), lambda a, b: a || b), '')) AS spoken_sha256,
  sha256(coalesce(array_to_string(inner_texts, ' '), '')) AS quoted_sha256 FROM d""")
def mask_quotes(spark, sf):
    """The record's quotation marks do not occur in the documents: ``the`` opens and ``of`` closes here, up to 100 characters apart."""
    spoken, quoted_text = tx.mask_quotes(F.coalesce("text", F.lit("")), "the", "of", 100)
    return spread(table(spark, sf, "documents")).select("doc_id", F.sha2(spoken, 256).alias("spoken_sha256"), F.sha2(quoted_text, 256).alias("quoted_sha256"))


IDIOMS_SQL = f"""low AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents),
refs AS ({spans("low", "doc_id", quoted(demo_scorer().idioms.phrases))})"""
DEMO_HITS = rf"(len(list_filter(regexp_extract_all(s, '{TOKEN_SQL}'), lambda x: x IN {one_of(DEMO.words)})) + len(regexp_extract_all(s, '\band\s+in\b')))"


@query("window_counts", f"""WITH {IDIOMS_SQL}, w AS ({windows("doc_id", "low", "refs")}), n AS (SELECT doc_id, count(*) AS refs FROM refs GROUP BY 1)
SELECT doc_id, coalesce(refs, 0)::INTEGER AS refs, coalesce({DEMO_HITS}, 0)::INTEGER AS near_hits FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN w USING (doc_id)""")
def window_counts(spark, sf):
    d = hits(spark, sf).withColumn("spans", tx.lexicon_spans(demo_scorer().idioms, F.col("low")))
    w = d.withColumn("win", tx.window_text(F.col("low"), F.col("spans")))
    return w.select("doc_id", F.size("spans").alias("refs"), tx.count_hits(DEMO, F.col("win"), tx.tokens(F.col("win"))).alias("near_hits"))


@query("context_counts", f"""WITH {IDIOMS_SQL}, c AS (SELECT doc_id, count(*) AS refs, count_if({DEMO_HITS} > 0) AS contexts FROM ({contexts("doc_id", "low", "refs")}) GROUP BY 1)
SELECT doc_id, coalesce(refs, 0)::INTEGER AS refs, coalesce(contexts, 0)::INTEGER AS contexts FROM documents LEFT JOIN c USING (doc_id)""")
def context_counts(spark, sf):
    d = hits(spark, sf).withColumn("spans", tx.lexicon_spans(demo_scorer().idioms, F.col("low"))).withColumn("ctx", tx.span_contexts(F.col("low"), F.col("spans")))
    return d.select("doc_id", F.size("ctx").alias("refs"), F.size(F.filter("ctx", lambda c: tx.count_hits(DEMO, c, tx.tokens(c)) > 0)).alias("contexts"))


@query("negated_spans", rf"""WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents), the AS (SELECT doc_id, st, en FROM ({spans("low", "doc_id", TOKEN_SQL)}) WHERE hit = 'the'),
k AS (SELECT doc_id, count(*) AS kept FROM ({unnegated("the", "low", "doc_id", r"\b(?:of|in)\s+\z", r"\A\s*(?:,\s*)?(?:or|and)\s*\z")}) GROUP BY 1), a AS (SELECT doc_id, count(*) AS spans FROM the GROUP BY 1)
SELECT doc_id, coalesce(spans, 0)::INTEGER AS spans, coalesce(kept, 0)::INTEGER AS kept FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)""")
def negated_spans(spark, sf):
    d = hits(spark, sf).withColumn("spans", tx.lexicon_spans(Lexicon.compile(["the"]), F.col("low")))
    kept = tx.unnegated(F.col("spans"), F.col("low"), r"\b(?:of|in)\s+\z", r"\A\s*(?:,\s*)?(?:or|and)\s*\z")
    return d.select("doc_id", F.size("spans").alias("spans"), F.size(kept).alias("kept"))


@query("party_case", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'D' WHEN c_mktsegment = 'MACHINERY' THEN 'R' WHEN c_mktsegment = 'FURNITURE' THEN 'I' ELSE 'other' END AS party,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'R' WHEN c_mktsegment = 'MACHINERY' THEN 'D' END AS opposing FROM customer""")
def party_case(spark, sf):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " democrat").when(F.col("c_mktsegment") == "MACHINERY", "200").when(F.col("c_mktsegment") == "FURNITURE", "Ind").otherwise("Whig")
    return table(spark, sf, "customer").select("c_custkey", dom.party_of(raw).alias("party"), dom.other_major_party(dom.party_of(raw)).alias("opposing"))


@query("congress_year", "SELECT DISTINCT year(o_orderdate)::INTEGER AS y, (floor((year(o_orderdate) - 1789) / 2.0) + 1)::INTEGER AS congress, (1789 + 2 * floor((year(o_orderdate) - 1789) / 2.0))::INTEGER AS first_year FROM orders")
def congress_year(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select(y.alias("y")).distinct().select("y", dom.congress_of_year(F.col("y")).alias("congress"), dom.year_of_congress(dom.congress_of_year(F.col("y"))).alias("first_year"))


@query("member_day", f"""WITH {SCORES_SQL}, s AS (SELECT * FROM turns JOIN scores USING (doc_id) WHERE NOT is_procedural),
w AS (SELECT bioguide, arg_max(party, date || lpad(doc_id::VARCHAR, 12, '0')) AS party FROM s GROUP BY bioguide)
SELECT s.bioguide, date, chamber, w.party, arg_max(congress, doc_id) AS congress, count(*)::BIGINT AS turns, sum(n_words)::BIGINT AS words, sum(profanity_hits)::BIGINT AS profanity_hits,
  sum(hostility_hits)::BIGINT AS hostility_hits, sum(misconduct_hits)::BIGINT AS misconduct_hits FROM s JOIN w USING (bioguide) GROUP BY s.bioguide, date, chamber, w.party""")
def member_day(spark, sf):
    """Scored turns to member-days. The texts hold no quotation marks of the record, so nothing is masked."""
    t = mem.attributed(turns(spark, sf)).withColumn("pos", F.col("doc_id"))
    return mem.member_day(mem.score_spoken(t, demo_scorer())).select("bioguide", "date", "chamber", "party", "congress", "turns", "words", *mem.HITS)


@query("latest_attrs", """WITH e AS (SELECT user_id, nullif(trim(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END), '') AS name, ts, event_id FROM events)
SELECT user_id, coalesce(arg_max(name, (epoch_us(ts)::HUGEINT * 10000000 + event_id)) FILTER (WHERE name IS NOT NULL), '') AS name FROM e GROUP BY user_id""")
def latest_attrs(spark, sf):
    e = table(spark, sf, "events").withColumn("name", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")))
    return e.groupBy("user_id").agg(mem.latest(F.col("name"), F.struct("ts", "event_id")).alias("name"))


SPEECH_SQL = f"""WITH {DAILY_SQL}, {BILLS_SQL},
s AS (SELECT bioguide, arg_max(party, date || chamber) AS party, arg_max(chamber, date || chamber) AS chamber, sum(turns)::BIGINT AS turns, sum(words)::BIGINT AS words, count(DISTINCT date) AS active_days,
  sum(profanity_hits)::BIGINT AS profanity_hits, sum(hostility_hits)::BIGINT AS hostility_hits, sum(misconduct_hits)::BIGINT AS misconduct_hits FROM daily WHERE chamber IN ('house', 'senate') GROUP BY bioguide),
b AS (SELECT sponsor_bioguide AS bioguide, count(DISTINCT bill_id) AS bills_sponsored, count_if(passed_any_chamber)::BIGINT AS bills_passed, count_if(became_law)::BIGINT AS bills_enacted FROM bills GROUP BY 1),
a AS (SELECT coalesce(s.bioguide, b.bioguide) AS bioguide, coalesce(s.party, '') AS party, coalesce(chamber, 'house') AS chamber, coalesce(turns, 0)::BIGINT AS turns, coalesce(words, 0)::BIGINT AS words, coalesce(active_days, 0)::BIGINT AS active_days,
  coalesce(profanity_hits, 0)::BIGINT AS profanity_hits, coalesce(hostility_hits, 0)::BIGINT AS hostility_hits, coalesce(misconduct_hits, 0)::BIGINT AS misconduct_hits,
  coalesce(bills_sponsored, 0)::BIGINT AS bills_sponsored, coalesce(bills_passed, 0)::BIGINT AS bills_passed, coalesce(bills_enacted, 0)::BIGINT AS bills_enacted,
  coalesce(bills_passed * 1.0 / bills_sponsored, 0)::DOUBLE AS passage_share, coalesce(bills_enacted * 1.0 / bills_sponsored, 0)::DOUBLE AS enactment_share,
  CASE WHEN coalesce(words, 0) = 0 THEN 0.0 ELSE profanity_hits * 100000.0 / words END::DOUBLE AS profanity_per_100k FROM s FULL JOIN b ON s.bioguide = b.bioguide)"""
ACTIVITY = ["bioguide", "party", "chamber", "turns", "words", "active_days", *mem.HITS, "bills_sponsored", "bills_passed", "bills_enacted", "passage_share", "enactment_share", "profanity_per_100k"]


def activity(spark, sf):
    return mem.member_activity(mem.speech_totals(daily(spark, sf), 118), mem.bill_totals(bills(spark, sf), 118))


@query("member_totals", f"{SPEECH_SQL} SELECT * FROM s")
def member_totals(spark, sf):
    return mem.speech_totals(daily(spark, sf)).select("bioguide", "party", "chamber", "turns", "words", "active_days", *mem.HITS)


@query("member_activity", f"{SPEECH_SQL} SELECT * FROM a")
def member_activity(spark, sf):
    return activity(spark, sf).select(*ACTIVITY)


def _board_sql(where: str, order: str, top: int = 25) -> str:
    return f"{SPEECH_SQL} SELECT row_number() OVER (ORDER BY {order}, bioguide) AS rank, * FROM a WHERE {where} QUALIFY rank <= {top}"


@query("board_words", _board_sql("words > 0", "words DESC, turns DESC"))
def board_words(spark, sf):
    return mem.activity_boards(activity(spark, sf))["speech"].select("rank", *ACTIVITY)


@query("board_sponsored", _board_sql("bills_sponsored > 0", "bills_sponsored DESC, bills_passed DESC"))
def board_sponsored(spark, sf):
    return mem.activity_boards(activity(spark, sf))["sponsored"].select("rank", *ACTIVITY)


@query("board_passed", _board_sql("bills_passed > 0", "bills_passed DESC, bills_sponsored DESC"))
def board_passed(spark, sf):
    return mem.activity_boards(activity(spark, sf))["passed"].select("rank", *ACTIVITY)


@query("board_enacted", _board_sql("bills_enacted > 0", "bills_enacted DESC, bills_sponsored DESC"))
def board_enacted(spark, sf):
    return mem.activity_boards(activity(spark, sf))["enacted"].select("rank", *ACTIVITY)


@query("board_rate_min_words", _board_sql("words >= 5000 AND profanity_hits > 0", "profanity_per_100k DESC, profanity_hits DESC"))
def board_rate_min_words(spark, sf):
    return mem.activity_boards(activity(spark, sf), min_words=5000)["profanity"].select("rank", *ACTIVITY)


@query("board_by_metric", f"""{SPEECH_SQL}, l AS (SELECT bioguide, party, chamber, words, turns, active_days, unnest([{{'metric': 'profanity', 'hits': profanity_hits}}, {{'metric': 'hostility', 'hits': hostility_hits}}, {{'metric': 'misconduct', 'hits': misconduct_hits}}], recursive := true) FROM s WHERE words >= 5000),
r AS (SELECT *, hits * 100000.0 / words AS rate_per_100k FROM l WHERE hits > 0)
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY rate_per_100k DESC, hits DESC, bioguide) AS rank FROM r QUALIFY rank <= 8""")
def board_by_metric(spark, sf):
    return mem.language_boards(daily(spark, sf), min_words=5000).select("bioguide", "party", "chamber", "words", "turns", "active_days", "metric", "hits", "rate_per_100k", "rank")


@query("profanity_board", f"""WITH {DAILY_SQL}, g AS (SELECT bioguide, sum(turns)::BIGINT AS turns, sum(words)::BIGINT AS words, sum(profanity_hits)::BIGINT AS profanity_hits, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY 1 HAVING sum(words) >= 5000),
r AS (SELECT *, profanity_hits * 100000.0 / words AS profanity_per_100k FROM g) SELECT row_number() OVER (ORDER BY profanity_per_100k DESC, profanity_hits DESC, bioguide) AS rank, * FROM r QUALIFY rank <= 25""")
def profanity_board(spark, sf):
    return mem.profanity_board(daily(spark, sf), min_words=5000).select("rank", "bioguide", "turns", "words", "profanity_hits", "first_date", "last_date", "profanity_per_100k")


@query("examples_top3", f"""{SPEECH_SQL}, x AS (SELECT sponsor_bioguide AS bioguide, bill_id, introduced_date, row_number() OVER (PARTITION BY sponsor_bioguide ORDER BY introduced_date DESC, bill_type, bill_number DESC)::INTEGER AS k FROM bills WHERE sponsor_bioguide IN (SELECT bioguide FROM s)) SELECT * FROM x WHERE k <= 3""")
def examples_top3(spark, sf):
    return mem.examples(mem.speech_totals(daily(spark, sf)), bills(spark, sf)).select("bioguide", "bill_id", "introduced_date", "k")


def actions(spark, sf):
    code = F.when(F.col("l_returnflag") == "R", "8000").when(F.col("l_returnflag") == "A", "17000").when(F.col("l_linestatus") == "F", "36000").otherwise("1")
    a = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("actionDate"), code.alias("actionCode"), F.lit("").alias("text"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(a).alias("actions"))


@query("milestones", """WITH l AS (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS d, CASE WHEN l_returnflag = 'R' THEN '8000' WHEN l_returnflag = 'A' THEN '17000' WHEN l_linestatus = 'F' THEN '36000' ELSE '1' END AS c FROM lineitem)
SELECT l_orderkey, count_if(c = '8000') > 0 AS passed_house, coalesce(min(d) FILTER (WHERE c = '8000'), '') AS passed_house_date, count_if(c = '17000') > 0 AS passed_senate, coalesce(min(d) FILTER (WHERE c = '17000'), '') AS passed_senate_date,
count_if(c IN ('8000', '17000')) > 0 AS passed_any_chamber, coalesce(min(d) FILTER (WHERE c = '36000'), '') AS became_law_date,
'[' || coalesce(string_agg(DISTINCT '"' || c || '"', ', ' ORDER BY '"' || c || '"') FILTER (WHERE c <> '1'), '') || ']' AS matched_action_codes FROM l GROUP BY 1""")
def milestones(spark, sf):
    return actions(spark, sf).select("l_orderkey", *(v.alias(k) for k, v in bl.milestones(F.col("actions")).items()))


@query("law_pick", """WITH l AS (SELECT l_orderkey, l_linenumber, (100 + l_suppkey % 10)::INTEGER AS c, l_partkey + 1 AS n, l_quantity > 25 AS good FROM lineitem),
g AS (SELECT l_orderkey, arg_min(c || '-' || n, lpad(l_linenumber::VARCHAR, 4, '0') || c || '-' || n) FILTER (WHERE good AND c = 105) AS own, arg_min(c || '-' || n, lpad(l_linenumber::VARCHAR, 4, '0') || c || '-' || n) FILTER (WHERE good) AS fst FROM l GROUP BY 1) SELECT l_orderkey, coalesce(own, fst) AS law FROM g""")
def law_pick(spark, sf):
    number = F.concat_ws("-", (100 + F.col("l_suppkey") % 10).cast("string"), (F.col("l_partkey") + 1).cast("string"))
    x = F.struct("l_linenumber", F.when(F.col("l_quantity") > 25, "Public Law").otherwise("Other").alias("type"), number.alias("number"))
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(x)).alias("laws"))
    return d.select("l_orderkey", bl.chosen_law(F.col("laws"), F.lit(105))["number"].alias("law"))


@query("upsert_latest", """WITH n AS (SELECT user_id, event_id, value, 1 AS gen FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
o AS (SELECT user_id, max(event_id) AS event_id, max(value) AS value, 0 AS gen FROM events GROUP BY user_id)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events")
    old = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value"), F.lit(0).alias("gen"))
    return dd.upsert(old, e.filter("event_id % 3 = 0").select("user_id", "event_id", "value", F.lit(1).alias("gen")), ["user_id"], [F.col("event_id")])


@query("changed_records", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_orderstatus <> 'F') OR o_orderdate > TIMESTAMP '2000-01-01'""")
def changed_records(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string").alias("stamp"))
    known = o.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("k_o_orderstatus"), F.lit(True).alias("k_known"))
    return dd.changed_records(o, known, "o_orderkey", ["o_orderstatus"], dom.is_newer(F.col("stamp"), F.lit("2000-01-01 00:00:00"))).select("o_orderkey", "o_orderstatus")


@query("replace_partition", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, 'old' AS gen FROM orders WHERE year(o_orderdate) <> 1997 UNION ALL SELECT o_orderkey, 1997, 'new' FROM orders WHERE year(o_orderdate) = 1997 AND o_orderkey % 2 = 0""")
def replace_partition(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return dd.replace_groups(o.withColumn("gen", F.lit("old")), o.filter("y = 1997 AND o_orderkey % 2 = 0").withColumn("gen", F.lit("new")), "y")


SERIES = "sum(words)::BIGINT AS words, sum(turns)::BIGINT AS turns, sum(profanity_hits)::BIGINT AS profanity_hits"


@query("series_year", f"WITH {DAILY_SQL} SELECT date[1:4] AS period, chamber, {SERIES}, CASE WHEN sum(words) = 0 THEN 0.0 ELSE sum(profanity_hits) * 100000.0 / sum(words) END::DOUBLE AS profanity_per_100k FROM daily GROUP BY ALL")
def series_year(spark, sf):
    return ser.chamber_series(daily(spark, sf)).select("period", "chamber", "words", "turns", "profanity_hits", "profanity_per_100k")


@query("series_month_party", f"WITH {DAILY_SQL} SELECT date[1:7] AS period, party, {SERIES}, CASE WHEN sum(words) = 0 THEN 0.0 ELSE sum(profanity_hits) * 100000.0 / sum(words) END::DOUBLE AS profanity_per_100k FROM daily WHERE chamber IN ('house', 'senate') AND party IN ('D', 'R') GROUP BY ALL")
def series_month_party(spark, sf):
    return ser.language_series(daily(spark, sf), 118).select("period", "party", "words", "turns", "profanity_hits", "profanity_per_100k")


@query("rollup_levels", f"{METRIC_SQL} SELECT year, party, chamber, grouping_id(year, party, chamber)::BIGINT AS level, sum(words)::BIGINT AS words, sum(hits)::BIGINT AS hits FROM m GROUP BY GROUPING SETS ((year, party), (year, party, chamber))")
def rollup_levels(spark, sf):
    return ser.rollup_levels(scored_table(spark, sf), [["year", "party"], ["year", "party", "chamber"]], ["words", "hits"]).select("year", "party", "chamber", "level", "words", "hits")


@query("pivot_asymmetry", f"""{METRIC_SQL}, g AS (SELECT year, chamber, avg(rate) FILTER (WHERE party = 'D') - avg(rate) FILTER (WHERE party = 'R') AS gap FROM m GROUP BY ALL HAVING count_if(party = 'R') > 0 AND count_if(party = 'D') > 0),
w AS (SELECT year, max(gap) FILTER (WHERE chamber = 'house') AS house, max(gap) FILTER (WHERE chamber = 'senate') AS senate FROM g GROUP BY year)
SELECT year, round(house, 9) AS house, round(senate, 9) AS senate, round((house + senate) / 2, 9) AS gap FROM w WHERE house IS NOT NULL AND senate IS NOT NULL""")
def pivot_asymmetry(spark, sf):
    wide = ser.chamber_mean_gap(scored_table(spark, sf), "rate", ["year"])
    return wide.select("year", *(F.round(c, 9).alias(c) for c in ("house", "senate", "gap")))


@query("rolling_centered", """WITH y AS (SELECT o_orderpriority AS party, year(o_orderdate)::INTEGER AS y, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT party, y, n, CASE WHEN count(n) OVER w >= 3 THEN round(avg(n) OVER w, 9) END AS n_smooth FROM y WINDOW w AS (PARTITION BY party ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_centered(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("party"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return ser.centred_mean(y, "n", "y", ["party"]).withColumn("n_smooth", F.round("n_smooth", 9))


CELLS_SQL = """WITH c AS (SELECT CASE l_linestatus WHEN 'F' THEN 'hein' ELSE 'govinfo' END AS fam, l_suppkey AS congress, 2000 AS year, 'house' AS chamber, 'D' AS party, l_returnflag AS metric, sum(l_quantity)::DOUBLE AS rate FROM lineitem GROUP BY ALL),
p AS (SELECT congress, metric, max(rate) FILTER (WHERE fam = 'hein') AS hein, max(rate) FILTER (WHERE fam = 'govinfo') AS govinfo FROM c GROUP BY ALL HAVING hein IS NOT NULL AND govinfo IS NOT NULL)"""


def cells(spark, sf):
    fam = F.when(F.col("l_linestatus") == "F", "hein").otherwise("govinfo")
    keys = [fam.alias("source_family"), F.col("l_suppkey").alias("congress"), F.lit(2000).alias("year"), F.lit("house").alias("chamber"), F.lit("D").alias("party"), F.col("l_returnflag").alias("metric")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("rate"))


@query("paired_overlap", f"{CELLS_SQL} SELECT congress, metric, hein, govinfo, govinfo - hein AS difference, hein / govinfo AS ratio FROM p")
def paired_overlap(spark, sf):
    p = cal.paired(cells(spark, sf))
    return p.select("congress", "metric", "hein", "govinfo", F.col("difference_govinfo_minus_hein").alias("difference"), F.col("ratio_hein_to_govinfo").alias("ratio"))


@query("calibration_summary", f"""{CELLS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY hein) + (count(*) OVER (PARTITION BY metric, hein) - 1) / 2.0 AS rl, rank() OVER (PARTITION BY metric ORDER BY govinfo) + (count(*) OVER (PARTITION BY metric, govinfo) - 1) / 2.0 AS rr FROM p)
SELECT metric, count(*) AS paired_cells, count_if(hein > 0 AND govinfo > 0)::BIGINT AS positive_paired_cells, round(corr(hein, govinfo), 9) AS pearson, round(corr(rl, rr), 9) AS spearman, round(avg(govinfo - hein), 6) AS mean_difference,
round(exp(quantile_cont(ln(hein / govinfo), 0.5)), 9) AS multiplier, round(quantile_cont(ln(hein / govinfo), 0.75) - quantile_cont(ln(hein / govinfo), 0.25), 9) AS log_ratio_iqr FROM r GROUP BY metric""")
def calibration_summary(spark, sf):
    s = cal.summary(cal.paired(cells(spark, sf)))
    return s.select("metric", "paired_cells", "positive_paired_cells", *(F.round(c, n).alias(c) for c, n in (("pearson", 9), ("spearman", 9), ("mean_difference", 6), ("multiplier", 9), ("log_ratio_iqr", 9))))


@query("calibrated_rates", """WITH c AS (SELECT l_returnflag AS metric, year(l_shipdate)::INTEGER AS year, sum(l_quantity)::DOUBLE AS rate FROM lineitem GROUP BY ALL)
SELECT metric, year, rate, CASE WHEN year >= 1998 THEN CASE metric WHEN 'A' THEN rate * 1.5 WHEN 'R' THEN NULL END ELSE rate END AS calibrated_rate FROM c""")
def calibrated_rates(spark, sf):
    long = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("rate"))
    m = spark.createDataFrame([("A", 1.5), ("R", None)], "metric string, recommended_multiplier double")
    return cal.calibrated(long, m, 1998)


@query("stratified_bottom_k", f"""WITH {TURNS_SQL}, p AS (SELECT turn_id, source || '|' || chamber AS stratum, substr(sha256('sample-v1|' || source || '|' || chamber || '|' || turn_id), 1, 16) AS h FROM turns)
SELECT turn_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, turn_id DESC)::INTEGER AS k FROM p QUALIFY k <= 5""")
def stratified_bottom_k(spark, sf):
    t = turns(spark, sf).select("turn_id", F.concat_ws("|", "source", "chamber").alias("stratum"))
    return smp.bottom_k(t, "stratum", dom.hash_priority(F.lit("sample-v1"), F.col("stratum"), F.col("turn_id")), F.col("turn_id"), 5)


@query("batch_slices", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents")
def batch_slices(spark, sf):
    return smp.slices(table(spark, sf, "documents").select("doc_id"), "doc_id")


def passes(spark, sf):
    lab = table(spark, sf, "labels").filter("doc_id IS NOT NULL")
    yes = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    a = lab.select(F.col("doc_id").cast("string").alias("sample_id"), yes("quality").alias("profanity"), yes("toxic").alias("personal_attack"))
    flip = F.when(F.col("sample_id").cast("long") % 7 == 0, F.lit("uncertain")).otherwise(F.col("profanity"))
    return a, a.withColumn("profanity", flip)


PASSES_SQL = """WITH a AS (SELECT doc_id::VARCHAR AS sample_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS profanity, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS personal_attack, doc_id FROM labels)"""


@query("agreement", f"{PASSES_SQL} SELECT 'profanity' AS field, count(*) AS n, avg(CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE 1.0 END) AS raw_agreement FROM a UNION ALL SELECT 'personal_attack', count(*), 1.0 FROM a")
def agreement(spark, sf):
    return agr.agreement(*passes(spark, sf), fields=("profanity", "personal_attack"))


@query("adjudication_rows", f"{PASSES_SQL} SELECT sample_id, profanity AS profanity_a, 'uncertain' AS profanity_b FROM a WHERE doc_id % 7 = 0")
def adjudication_rows(spark, sf):
    return agr.to_adjudicate(*passes(spark, sf), fields=("profanity", "personal_attack")).select("sample_id", "profanity_a", "profanity_b")


PR_FIELDS = {"profanity": "score_p", "personal_attack": "score_a"}


@query("precision_recall", rf"""{PASSES_SQL}, j AS (SELECT a.*, d.source AS source_family, CASE WHEN a.doc_id % 2 = 0 THEN 'early' ELSE 'late' END AS era, length(d.text) % 3 > 0 AS pp, length(d.text) % 2 > 0 AS pa FROM a JOIN documents d ON a.doc_id = d.doc_id),
l AS (SELECT era, source_family, 'profanity' AS field, profanity AS label, pp AS pred FROM j UNION ALL SELECT era, source_family, 'personal_attack', personal_attack, pa FROM j),
g AS (SELECT field, CASE WHEN grouping(era) = 1 THEN 'all' ELSE era END AS era, CASE WHEN grouping(era) = 1 THEN 'all' ELSE source_family END AS source_family, count(*) AS n_coded, count_if(label = 'yes' AND pred)::BIGINT AS tp, count_if(label = 'no' AND pred)::BIGINT AS fp, count_if(label = 'yes' AND NOT pred)::BIGINT AS fn
  FROM l GROUP BY GROUPING SETS ((field), (field, era, source_family)))
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM g""")
def precision_recall(spark, sf):
    a, _ = passes(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), (F.length("text") % 3).alias("score_p"), (F.length("text") % 2).alias("score_a"), F.when(F.col("doc_id") % 2 == 0, "early").otherwise("late").alias("era"), F.col("source").alias("source_family"))
    return agr.precision_recall(a, d.select("sample_id", "score_p", "score_a"), d, PR_FIELDS)


@query("manifest_profile", "SELECT count_if(event_type <> 'view')::BIGINT AS rows, count(DISTINCT user_id) FILTER (WHERE event_type <> 'view') AS distinct_ids, count_if(event_type = 'view')::BIGINT AS malformed, min(strftime(ts, '%Y-%m-%d')) FILTER (WHERE event_type <> 'view') AS first_date, max(strftime(ts, '%Y-%m-%d')) FILTER (WHERE event_type <> 'view') AS last_date, (count_if(event_type <> 'view') - count(DISTINCT user_id) FILTER (WHERE event_type <> 'view'))::BIGINT AS duplicate_rows FROM events")
def manifest_profile(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return cov.manifest_profile(e, "user_id", "day", F.col("event_type") == "view")


@query("rows_by_year", "SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS rows FROM orders GROUP BY 1")
def rows_by_year(spark, sf):
    return cov.rows_by_year(table(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")), "d")


@query("interior_gaps", """WITH m AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'P') SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE BETWEEN (SELECT min(day) FROM m) AND (SELECT max(day) FROM m) AND l_shipdate::DATE NOT IN (SELECT day FROM m)""")
def interior_gaps(spark, sf):
    corpus = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    manifest = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day"))
    return cov.interior_gaps(corpus, manifest, "day")


@query("unmerged_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def unmerged_ids(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return cov.still_open(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("missing_dates", "SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)")
def missing_dates(spark, sf):
    return cov.missing(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct(), table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


@query("resume_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_semi_join(spark, sf):
    return cov.reconcile(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("month_chunks", """WITH b AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM events)
SELECT greatest(a, m::DATE) AS start, least(z, last_day(m::DATE)) AS "end" FROM b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH)) t(m)""")
def month_chunks(spark, sf):
    return cov.month_chunks_of(table(spark, sf, "events"), F.to_date("ts"))


@query("corpus_extent", f"""WITH {DAILY_SQL}, {BILLS_SQL} SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS rows, count(DISTINCT bioguide) AS members, (SELECT count(DISTINCT bill_id) FROM bills) AS bills FROM daily""")
def corpus_extent(spark, sf):
    return rep.corpus_extent(daily(spark, sf), bills(spark, sf)).drop("congresses")


@query("party_findings", f"""WITH {DAILY_SQL}, p AS (SELECT party, sum(words) AS w, sum(profanity_hits) AS a, sum(hostility_hits) AS b, sum(misconduct_hits) AS c FROM daily WHERE chamber IN ('house', 'senate') AND party IN ('D', 'R') GROUP BY party),
l AS (SELECT m.metric, max(CASE WHEN party = 'D' THEN m.h * 100000.0 / w END) AS d_rate, max(CASE WHEN party = 'R' THEN m.h * 100000.0 / w END) AS r_rate FROM p, unnest([{{'metric': 'profanity', 'h': a}}, {{'metric': 'hostility', 'h': b}}, {{'metric': 'misconduct', 'h': c}}]) t(m) GROUP BY 1)
SELECT *, CASE WHEN abs(d_rate - r_rate) < 0.05 THEN 'tie' WHEN d_rate > r_rate THEN 'D' ELSE 'R' END AS leader FROM l""")
def party_findings(spark, sf):
    return rep.party_findings(daily(spark, sf))


SIGNALS = ("formal_courtesy_hits", "gratitude_praise_hits", "hostility_hits", "misconduct_hits")
_PAIRS = [(a, b) for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :]]
_AVERAGE_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in SIGNALS)


@query("signal_correlations", f"WITH {SCORES_SQL}, r AS (SELECT {_AVERAGE_RANKS} FROM scores) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS spearman FROM r" for a, b in _PAIRS))
def signal_correlations(spark, sf):
    scored = score_turns(turns(spark, sf), demo_scorer()).select(*SIGNALS)
    return rep.rank_correlations(scored, list(SIGNALS)).withColumn("spearman", F.round("spearman", 9))


@query("final_labels", f"{PASSES_SQL} SELECT sample_id, CASE WHEN doc_id % 7 = 0 THEN 'no' ELSE profanity END AS profanity, personal_attack, CASE WHEN doc_id % 7 = 0 THEN 'high' ELSE 'low' END AS confidence FROM a")
def final_labels(spark, sf):
    a, b = (x.withColumn("confidence", F.lit("low")).withColumn("rationale", F.lit("r")) for x in passes(spark, sf))
    third = a.filter("sample_id % 7 = 0").withColumn("profanity", F.lit("no")).withColumn("confidence", F.lit("high"))
    return agr.final_labels(a, b, third, ("profanity", "personal_attack")).drop("rationale")


@query("annotation_violations", f"{PASSES_SQL} SELECT sample_id, 'profanity' AS field, 'maybe' AS value FROM a WHERE doc_id % 11 = 0")
def annotation_violations(spark, sf):
    a, _ = passes(spark, sf)
    return agr.vocabulary_violations(a.withColumn("profanity", F.when(F.col("sample_id") % 11 == 0, "maybe").otherwise(F.col("profanity"))))


@query("id_differences", f"{PASSES_SQL} SELECT sample_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS only_in FROM a WHERE doc_id % 3 = 0 OR (doc_id % 5 = 0 AND doc_id % 3 <> 0)")
def id_differences(spark, sf):
    a, _ = passes(spark, sf)
    return agr.id_differences(a.filter("sample_id % 5 <> 0 OR sample_id % 3 = 0"), a.filter("sample_id % 3 <> 0"))


@query("incremental_totals", f"WITH {SCORES_SQL}, {SUMS_SQL} SELECT * FROM spoken")
def incremental_totals(spark, sf):
    """Shard sums merged; equal to the full table (tested)."""
    t = turns(spark, sf).withColumn("shard", F.concat_ws(":", "source", F.col("congress").cast("string"))).withColumn("file", F.col("source")).withColumn("pos", F.col("doc_id"))
    return inc.totals(inc.shard_sums(t, demo_scorer()))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return full_metric_table(spark, sf)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from lectern import source_queries as _source_queries  # noqa: E402, F401  registers its queries here
