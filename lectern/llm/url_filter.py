"""URL filter: a rule list first, then association rules mined from labelled URLs.

A listed rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's
path; the longest wins. URLs that no listed rule decides get the verdict of mined rules: Spark's FP-growth
finds token combinations of labelled URLs whose consequent is the label, pruned by support and confidence.
Mined rules match by an inverted index: each is filed under its rarest token, so a URL only meets rules that
share that token, and the rest of the antecedent is checked against the URL's tokens.

Mining sees the labelled URLs alone. A rule needs ``MIN_URLS`` of them, or the share ``MIN_SUPPORT`` if that is more, a
confidence (share of those that have the tokens) of ``MIN_CONFIDENCE``, and ``MIN_LAPLACE`` for its confidence as estimated
with one more URL on either side, so that few URLs do not make a sure rule. All tokens of a URL take part. FP-growth only sees
tokens that are frequent enough alone, and tokens that occur in exactly the same URLs are one item, so long path templates do not
multiply item sets; such a rule holds for a URL with any of them. Where no mined rule holds, and between equally confident
ones, the verdict is allow.

Null or malformed urls have empty host and path, no rule and the verdict allow. Every input row has a result
row, also if page_id is null or repeated. Equal lengths cannot compete: a longer rule differs in host or path,
and of equal ones the alphabetically first verdict counts. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
MIN_URLS = 5
MIN_LAPLACE = 0.85
MAX_ANTECEDENT = 3
BROADCAST_ROWS = 100_000

#: Rule list of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def listed_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, rule_verdict) for the rows of (row, host, path) that a listed rule fits; the longest one.

    A host is looked up by its suffixes of as many labels as some rule's host has, so a long host makes no more of them.
    """
    lengths = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().collect())  # label counts of rules
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in lengths])) if lengths else F.array().cast("array<string>")
    named = urls.filter("host <> ''").select("row", "path", F.explode(suffixes).alias("rule_host"))
    fits = named.join(small_or_shuffled(rules, BROADCAST_ROWS), "rule_host").filter(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    longest = Window.partitionBy("row").orderBy(F.desc(F.length("rule")), "rule", "rule_verdict")
    return fits.select("row", rule.alias("rule"), "rule_verdict").withColumn("k", F.row_number().over(longest)).filter("k = 1").drop("k")


def tokens() -> Column:
    """Distinct tokens of host, path and url: host labels with their place from the right, path parts, query keys."""
    labels = F.split("host", r"\.")
    host = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    parts = F.array_remove(F.split("path", "/"), "")
    path = F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    found = F.array_distinct(F.concat(host, path, keys))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(found)


MINED = "antecedent array<string>, verdict string, confidence double, support double"


@dataclass
class MinedRules:
    """Rules over items, and the tokens that stand for each item."""

    rules: DataFrame  # antecedent (sorted items), verdict, confidence, support
    items: DataFrame  # token, item


def merged_tokens(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that ``least`` rows of (row, tokens) have; tokens of exactly the same rows share an item.

    The set of a token's rows is told by its size and 128 bits of exclusive ors, which add up before the shuffle.
    """
    rows = labelled.select(F.xxhash64("row").alias("a"), F.xxhash64(F.lit("second"), "row").alias("b"), F.explode(F.array_distinct("tokens")).alias("token"))
    sets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).filter(F.col("n") >= least)
    sets = stored(sets, "url-token-sets")
    return stored(sets.join(sets.groupBy("n", "a", "b").agg(F.min("token").alias("item")), ["n", "a", "b"]).select("token", "item"), "url-items")


def as_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, items): the distinct items of each row's tokens; rows without any are left out."""
    named = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token")).join(small_or_shuffled(items, BROADCAST_ROWS), "token")
    return named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, longest: int = MAX_ANTECEDENT, min_urls: int = MIN_URLS, min_laplace: float = MIN_LAPLACE) -> MinedRules:
    """Rules of (tokens, label); rows without a label are left out."""
    known = stored(labelled.filter(F.col("label").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "tokens", "label"), "url-labelled")
    n = known.count()
    least = max(min_urls, math.ceil(min_support * n))
    items = merged_tokens(known, least)
    if n < least:
        return MinedRules(labelled.sparkSession.createDataFrame([], MINED), items)
    label = F.concat(F.lit("label="), F.col("label"))
    found = known.join(as_items(known, items), "row", "left")
    baskets = stored(found.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(label)).alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.startswith(F.element_at("consequent", 1), F.lit("label=")))
    rules = rules.filter((F.size("antecedent") <= longest) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("label="))))
    both = F.round(F.col("support") * n)
    rules = rules.filter((both + 1) / (F.round(both / F.col("confidence")) + 2) >= min_laplace)
    verdict = F.substring_index(F.element_at("consequent", 1), "=", -1)
    return MinedRules(stored(rules.select(F.sort_array("antecedent").alias("antecedent"), verdict.alias("verdict"), "confidence", "support"), "url-mined"), items)


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules filed under the rarest item of their antecedent among the URLs (row, items)."""
    rules = rules.withColumn("rule_id", F.sha2(F.concat_ws(" ", "antecedent", "verdict"), 256))
    wanted = rules.select(F.explode("antecedent").alias("item")).distinct()
    wanted = small_or_shuffled(stored(wanted, "url-wanted"), BROADCAST_ROWS)
    counts = urls.select(F.explode("items").alias("item")).join(wanted, "item").groupBy("item").count()
    order = Window.partitionBy("rule_id").orderBy("count", "item")
    filed = rules.select("rule_id", F.explode("antecedent").alias("item")).join(counts, "item")
    filed = filed.withColumn("k", F.row_number().over(order)).filter("k = 1").select("rule_id", "item")
    return stored(filed.join(rules, "rule_id").select("item", "antecedent", "verdict", "confidence"), "url-index")


def mined_verdicts(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(row, mined_verdict, confidence): the most confident mined rule that the items of a row (row, items) satisfy."""
    met = urls.select("row", "items", F.explode("items").alias("item")).join(small_or_shuffled(index, BROADCAST_ROWS), "item")
    met = met.filter(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", (F.col("verdict") == "allow").alias("milder"), "verdict")).alias("best")
    return met.groupBy("row").agg(best).select("row", F.col("best.verdict").alias("mined_verdict"), F.col("best.confidence").alias("confidence"))


def url_parts(pages: DataFrame) -> DataFrame:
    """(row, page_id, host, path, tokens) of every row; a stored table."""
    urls = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return stored(urls.withColumn("tokens", tokens()).drop("url"), "url-parts")


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, confidence (of a mined verdict).

    ``labels``: (url, label) to mine from; by default the URLs that listed rules decide are the labelled ones, which
    spreads the list's judgement to URLs built alike.
    """
    urls = url_parts(pages)
    listed = stored(listed_verdicts(urls, rules), "url-listed")
    if labels is None:
        train = urls.join(listed, "row", "left").select("tokens", F.col("rule_verdict").alias("label"))
    else:
        train = labels.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).select(tokens().alias("tokens"), "label")
    mined = mine(train)
    open_urls = stored(as_items(urls.join(listed.select("row"), "row", "left_anti"), mined.items), "url-open")
    index = rule_index(mined.rules, open_urls)
    judged = urls.select("row", "page_id", "host", "path").join(listed, "row", "left").join(mined_verdicts(open_urls, index), "row", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "confidence")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_frame(spark))


def url_listed(spark, sf_dir: str) -> DataFrame:
    """What the listed rules alone decide, which SQL can state."""
    urls = url_parts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    listed = listed_verdicts(urls, rule_frame(spark))
    return urls.join(listed, "row", "left").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("listed_verdict"))


URL_LISTED_SQL = """
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
x AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
u AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM x)
SELECT page_id, host, path, h || p AS rule, v AS listed_verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) = 1
"""
