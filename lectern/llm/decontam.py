"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed as postings ``(term, row, pos)``. Every benchmark window (``n`` consecutive item
words; a shorter item is one window) is looked up from its rarest terms: the postings of its two rarest
words are shifted by the words' offsets in the window, so that both lists hold candidate start positions,
and intersected. What is left is compared word for word with the neighbourhood that each posting carries.

Only terms that are among the two rarest of some window are ever looked up, so only those are stored. Term
frequencies come from all documents. Everything is DataFrame functions; no Python runs on executors.

Defined results: null or wordless texts have no words, are not contaminated and still have a row; null
item texts have no windows; every input row has its own result row, also if its doc_id is null or repeated;
equal item texts under several item_ids are all reported; other columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.broadcasts import is_small, small_or_shuffled
from lectern.plans.parallelism import spread
from lectern.plans.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 13
#: Test-side tables with at most so many rows are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of one-byte characters take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def item_windows(benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """(item_id as string, phrase, window): the distinct windows of each item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("window"))
    return windows.select("item_id", F.array_join("window", " ").alias("phrase"), "window").distinct()


@dataclass
class PhraseIndex:
    """Postings of the lookup terms and the plan of lookups; all are stored tables.

    Where the terms can be broadcast, a posting carries the words around it. Beyond that, postings are slim, since they are shuffled
    by term, and the words of the documents are fetched by row for what the intersections leave.
    """

    postings: DataFrame  # row, doc_id, n_words, pos, term, and if not slim around, around_from; term null: no posting, only the document
    lookups: DataFrame  # phrase, window, size, rank (1: rarest), term, offset
    items: DataFrame  # item_id, phrase
    words: DataFrame | None = None  # row, w: the documents' words, if postings are slim


def build_index(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> PhraseIndex:
    items = stored(item_windows(benchmark, n), "decontam-items")
    windows = items.select("phrase", "window").distinct()
    terms = stored(windows.select("phrase", "window", F.posexplode("window").alias("offset", "term")), "decontam-window-terms")
    docs = documents.select("doc_id", words_of(F.col("text")).alias("w"))

    vocabulary = stored(terms.select("term").distinct(), "decontam-terms")
    slim = not is_small(vocabulary, BROADCAST_ROWS)
    if slim:
        # Words are counted before they meet the vocabulary, so what is shuffled is a row a word and task.
        docs = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "w"), "decontam-words")
        frequency = docs.select(F.explode("w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("frequency")).join(vocabulary, "term")
    else:
        frequency = docs.select(F.explode("w").alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    frequency = small_or_shuffled(stored(frequency, "decontam-frequency"), BROADCAST_ROWS)

    # A window with a term that no document has cannot occur.
    by_rarity = Window.partitionBy("phrase").orderBy("frequency", "offset")
    lookups = (
        terms.join(frequency, "term")
        .withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("phrase")))
        .filter((F.col("known") == F.size("window")) & (F.col("rank") <= 2))
        .select("phrase", "window", F.size("window").alias("size"), "rank", "term", "offset")
    )
    lookups = stored(lookups, "decontam-lookups")
    keys = stored(lookups.select("term").distinct(), "decontam-keys")
    items = items.select("item_id", "phrase")
    if slim:
        return PhraseIndex(stored(slim_postings(docs, keys), "decontam-postings"), lookups, items, docs.select("row", "w"))

    begin = F.greatest(F.col("pos") - (n - 1), F.lit(0))
    postings = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "w")
        .select("row", "doc_id", F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "term"))
        .join(F.broadcast(keys.withColumn("is_key", F.lit(True))), "term", "left")
        .filter(F.col("is_key") | F.coalesce(F.col("pos") == 0, F.lit(True)))
        .select(
            "row", "doc_id", "n_words", "pos",
            F.when(F.col("is_key"), F.col("term")).alias("term"),
            F.when(F.col("is_key"), F.slice("w", begin + 1, 2 * n - 1)).alias("around"),
            begin.alias("around_from"),
        )
    )
    return PhraseIndex(stored(postings, "decontam-postings"), lookups, items)


def slim_postings(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, pos, term) of the lookup terms, and a row of pos null for each document.

    What is shuffled is (term, row, pos); a document's words stay where they are.
    """
    places = docs.select("row", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "term")).join(keys, "term")
    held = places.select("row", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "pos", "term")
    heads = docs.select("row", "doc_id", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("term"))
    return heads.unionByName(held)


def _shifted(index: PhraseIndex, rank: int, *more: str) -> DataFrame:
    """Offset-adjusted posting list of the rank-th rarest term of every window: its candidate starts."""
    wanted = small_or_shuffled(index.lookups.filter(F.col("rank") == rank), BROADCAST_ROWS)
    start = F.col("pos") - F.col("offset")
    return (
        index.postings.filter(F.col("term").isNotNull())
        .join(wanted, "term")
        .filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .select("row", "phrase", start.alias("start"), "size", *more)
    )


def phrase_matches(index: PhraseIndex) -> DataFrame:
    """(row, phrase, start, size): every occurrence of every window, exactly."""
    near = () if index.words is not None else ("around", "around_from")
    rarest = _shifted(index, 1, "window", *near)
    second = _shifted(index, 2).select("row", "phrase", "start")
    both = rarest.filter(F.col("size") > 1).join(second, ["row", "phrase", "start"], "left_semi")
    found = both.unionByName(rarest.filter(F.col("size") == 1))
    if index.words is not None:
        found = found.join(index.words, "row").withColumnRenamed("w", "around").withColumn("around_from", F.lit(0))
    # greatest(): Spark may test this before it drops starts that lie before the text.
    here = F.slice("around", F.greatest(F.col("start") - F.col("around_from") + 1, F.lit(1)), F.col("size"))
    return found.filter(here == F.col("window")).select("row", "phrase", "start", "size")


def proximity_matches(index: PhraseIndex, slop: int) -> DataFrame:
    """(row, phrase, start): the two rarest terms of a window stand within ``slop`` words of their places.

    ``slop`` 0 is a phrase candidate. Candidate starts are dealt into cells of ``slop + 1`` positions, and
    each list-1 start meets the list-2 starts of its own and the two neighbouring cells.
    """
    cell = F.floor(F.col("start") / (slop + 1))
    a = _shifted(index, 1).select("row", "phrase", "start", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = _shifted(index, 2).select("row", "phrase", F.col("start").alias("other"), cell_of("start", slop).alias("cell"))
    near = a.join(b, ["row", "phrase", "cell"]).filter(F.abs(F.col("start") - F.col("other")) <= slop)
    return near.select("row", "phrase", "start").distinct()


def cell_of(name: str, slop: int) -> Column:
    return F.floor(F.col(name) / (slop + 1))


def contamination(index: PhraseIndex) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted array of strings)."""
    matches = stored(phrase_matches(index), "decontam-matches")
    spans = matches.select("row", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))), F.lit(0))
    hits = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = (
        matches.select("row", "phrase").distinct().join(small_or_shuffled(index.items, BROADCAST_ROWS), "phrase")
        .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    head = F.col("pos").isNull() if index.words is not None else F.coalesce(F.col("pos") == 0, F.lit(True))
    rows = index.postings.filter(head).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hits.join(items, "row", "full"), "row", "left").select(
        "row", "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )


def is_contaminated() -> Column:
    """At least 5 % of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """The documents (all their columns) that are not contaminated.

    Rows are matched by doc_id and text, so a doc_id that is null or given to several texts is judged by text.
    """
    bad = contamination_by_text(documents, benchmark, n).filter(is_contaminated())
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marked = documents.withColumn("_text_key", key)
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    bad = small_or_shuffled(stored(bad, "decontam-bad"), BROADCAST_ROWS)
    on = marked["doc_id"].eqNullSafe(bad["_bad_id"]) & (marked["_text_key"] == bad["_bad_key"])
    return marked.join(bad, on, "left_anti").drop("_text_key")


def contamination_by_text(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """As :func:`contamination`, with a 64-bit key of the text beside the doc_id."""
    keyed = documents.select(
        F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key")).alias("doc_id"), "text"
    )
    found = contamination(build_index(keyed, benchmark, n))
    return found.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.key").alias("text_key"), "n_words", "n_hit", "n_items", "item_ids")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(build_index(documents, benchmark))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 13], ' ') AS phrase, least(len(w), 13) AS size
        FROM b, unnest(range(0, greatest(len(w) - 12, 1))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, s.size, i, array_to_string(w[i + 1 : i + s.size], ' ') AS phrase
       FROM d, sizes s, unnest(range(0, greatest(len(w) - s.size + 1, 0))) t(i)),
m AS (SELECT doc_id, item_id, i, win.size FROM dw JOIN win ON dw.phrase = win.phrase AND dw.size = win.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + size)) t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
