"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find emails, IP addresses, card and phone numbers. Those seeds induce lexical patterns: the one, two
and three words to the left. Words end at white space and after label marks (``account:99`` is ``account:`` and
``99``); a word counts once for a kind. Other identifier-like strings are candidates. Candidates shaped like keys
(16 or more letters and digits, both kinds) are seeds of a fifth kind, ``secret``; for candidates the letters they
begin with are a lexical pattern too, as keys of one issuer begin alike. Seeds of this kind become spans only
where a pattern says so.

Patterns and instances (seeds and candidates) form a graph; Spark scores it for ``ROUNDS`` rounds: a pattern's
confidence for a kind is the confident share of all places where an identifier-like string follows it, an
instance's is that of its surest pattern, if that is sure enough to discover (the contexts of one place hold one
another, so they are no independent witnesses, and weak patterns must not raise themselves through their instances). Candidates that follow a pattern of at least ``MIN_CONFIDENCE``, which
has ``MIN_SUPPORT`` different instances, become spans of its kind.

Offsets are code points, ends exclusive. Null texts count as empty; every input row has a result row, also if
its doc_id is null or repeated. Other columns are ignored. Patterns of regular expressions are written so that
Java neither recurses nor rescans long runs; they find what the plain forms in the comments find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.parallelism import spread
from lectern.plans.scratch import stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
BROADCAST_ROWS = 200_000
#: A run of letters, digits and the marks inside identifiers with what follows it, or such other marks alone.
WORD = r"[\p{L}\p{M}\p{N}._%+@/\x01-]++[^\s\p{L}\p{M}\p{N}._%+@/\x01-]*+|[^\s\p{L}\p{M}\p{N}._%+@/\x01-]++"
#: Stands before each match while the words are cut.
MARK = "\x01"

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([ -]?[0-9])+ where it has 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    # as it is
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Labels, then the string: without white space, brackets or quotes, from the start of a run or behind its labels, to
#: the last letter or digit of the run. Groups of hexadecimal digits are no labels.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+@/:#-])(?=[A-Za-z._%+@/:#-]*+[0-9])((?:(?!(?:[0-9A-Fa-f]{1,4}:){2})[A-Za-z][A-Za-z._-]*+[:#](?=[A-Za-z0-9]))*+)"
    r"([A-Za-z0-9][A-Za-z0-9._%+@/:#-]{3,}[A-Za-z0-9])"
)


#: A key: 16 or more letters and digits, at least two digits and a letter.
SECRET = r"\A(?=[A-Za-z]*+[0-9][A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+\z"
#: Letters that a candidate begins with, as a pattern.
PREFIX_LETTERS = 4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 if above 9; the sum ends in 0."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """What a match must be besides: parts at most 255, Luhn, or 9 to 15 digits."""
    small = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.right(p, F.lit(3)), 3, "0"), F.lit("999")), F.lit(999)) <= 255))
    count = F.length(_digits(value))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when((count >= 12) & (count <= 19), luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", (count >= 9) & (count <= 15))
        .otherwise(True)
    )


def _normal(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def words(text: Column) -> Column:
    """The words of a text, lower-cased and with 0 for every digit."""
    return F.regexp_extract_all(_normal(text), F.lit(WORD), F.lit(0))


def _lefts(text: Column, pattern: str) -> Column:
    """For each match the place of the word that it starts in, and its contexts: the one, two and three words before."""
    clean = lambda w: F.translate(w, MARK, "")
    marked = F.regexp_replace(F.translate(text, MARK, "\x02"), pattern, f"$1{MARK}$2")

    def left(w: Column, i: Column) -> Column:
        one = clean(F.get(w, i - 1))
        two = F.concat(clean(F.get(w, i - 2)), F.lit(" "), one)
        three = F.concat(clean(F.get(w, i - 3)), F.lit(" "), two)
        return F.filter(F.array(one, two, three), lambda x: x.isNotNull())

    def lefts(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.contains(F.get(w, i), F.lit(MARK)))
        count = lambda x: F.length(x) - F.length(clean(x))
        return F.flatten(F.transform(starts, lambda i: F.array_repeat(F.struct(i.alias("word"), left(w, i).alias("left")), count(F.get(w, i)))))

    return F.element_at(F.transform(F.array(words(marked)), lefts), 1)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (length of what stands between, match, its word, its contexts); the last match is null.

    Group 2 of the pattern is the match, group 1 the labels before it.
    """
    all_of = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    found = F.zip_with(F.zip_with(all_of(1), all_of(2), lambda b, m: F.struct(F.length(b).alias("label"), m.alias("value"))), _lefts(text, pattern), lambda m, x: F.struct(m["label"].alias("label"), m["value"].alias("value"), x["word"].alias("word"), x["left"].alias("left")))
    parts = F.zip_with(
        F.split(text, pattern, -1), found,
        lambda b, m: F.struct((F.length(b) + F.coalesce(m["label"], F.lit(0))).alias("gap"), m["value"].alias("value"), m["word"].alias("word"), m["left"].alias("left")),
    )
    return F.when(text.rlike(pattern), parts)


def find_strings(documents: DataFrame) -> DataFrame:
    """(row, doc_id, finds): for every row the matches of each kind and the candidates; a stored table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("t"))
    digit = F.col("t").rlike("[0-9]")
    needs = {"email": F.contains("t", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("t", F.lit("+")), "": digit}
    nothing = F.array().cast("array<struct<gap:int,value:string,word:int,left:array<string>>>")
    finds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.coalesce(F.when(need, _matches(F.col("t"), f"()({PATTERNS[k]})" if k else CANDIDATE)), nothing).alias("parts"))
        for k, need in needs.items()
    ])
    return stored(docs.select("row", "doc_id", F.filter(finds, lambda f: F.size(f["parts"]) > 1).alias("finds")), "pii-finds")


def positioned(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left): base matches that hold, and candidates (kind '') clear of them.

    ``left`` has the contexts of the first match of a kind in a word and is empty for others in that word.
    """
    one = found.select("row", F.explode("finds").alias("f")).select("row", F.col("f.kind").alias("kind"), F.posexplode("f.parts").alias("i", "p"))
    one = one.select("row", "kind", "i", F.col("p.gap").alias("gap"), F.col("p.value").alias("value"), F.col("p.word").alias("word"), F.col("p.left").alias("left")).filter("value IS NOT NULL")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    placed = one.select("row", "kind", (end - F.length("value")).cast("long").alias("start"), end.cast("long").alias("end"), "value", "word", "left")
    is_base = F.col("kind") != ""
    enough = (F.length(_digits(F.col("value"))) >= 4) | is_secret(F.col("value"))
    placed = placed.filter(F.when(is_base, holds(F.col("kind"), F.col("value"))).otherwise(enough))
    # Of matches that start together the base one comes first, so one of the two windows sees every overlap.
    earlier = F.max(F.when(is_base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", ~is_base).rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(is_base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), ~is_base).rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.withColumn("earlier", earlier).withColumn("later", later)
    clear = (F.coalesce(F.col("earlier"), F.lit(-1)) <= F.col("start")) & (F.col("later").isNull() | (F.col("later") >= F.col("end")))
    clear_places = marked.filter(is_base | clear).drop("earlier", "later")
    first = F.row_number().over(Window.partitionBy("row", "kind", "word").orderBy("start")) == 1
    left = F.when(F.col("first"), F.col("left")).otherwise(F.array().cast("array<string>"))
    begins = F.regexp_extract(F.lower("value"), rf"\A[a-z]{{{PREFIX_LETTERS}}}", 0)
    left = F.when((F.col("kind") == "") & (begins != ""), F.concat(left, F.array(F.concat(begins, F.lit("*"))))).otherwise(left)
    return stored(clear_places.withColumn("first", first).withColumn("left", left).drop("first", "word"), "pii-positions")


def is_secret(value: Column) -> Column:
    return value.rlike(SECRET)


def confident_patterns(places: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) after ``rounds`` rounds over the pattern-instance graph.

    Hot patterns and instances meet in aggregations with map-side combine; joins are of stored tables, which Spark
    splits at hot keys.
    """
    value = _normal_value(F.col("value"))
    edges = places.select(F.explode("left").alias("pattern"), value.alias("value")).groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"))
    edges = stored(edges, "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("total")).filter(F.col("s") >= min_support)
    totals = stored(totals.select("pattern", "total"), "pii-totals")
    edges = stored(edges.join(small_or_shuffled(totals, BROADCAST_ROWS), "pattern"), "pii-graph")
    seed = F.when(F.col("kind") != "", F.col("kind")).when(is_secret(F.col("value")), "secret")
    seeds = stored(places.select(value.alias("value"), seed.alias("kind")).filter("kind IS NOT NULL").distinct().withColumn("belief", F.lit(1.0)), "pii-seeds")
    beliefs, scored = seeds, None
    for k in range(rounds):
        scored = edges.join(beliefs, "value").groupBy("pattern", "kind").agg(F.least(F.sum(F.col("n") * F.col("belief")) / F.max("total"), F.lit(1.0)).alias("confidence"))
        scored = stored(scored, "pii-patterns")
        if k < rounds - 1:
            spread = edges.join(scored.filter(F.col("confidence") >= MIN_CONFIDENCE), "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("belief"))
            beliefs = stored(seeds.unionByName(spread.join(seeds.select("value").distinct(), "value", "left_anti")), "pii-beliefs")
    return scored


def _normal_value(value: Column) -> Column:
    return F.lower(value)


def discovered(places: DataFrame, patterns: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(row, kind, start, end) of candidates behind a confident pattern; the most confident one names the kind."""
    sure = small_or_shuffled(stored(patterns.filter(F.col("confidence") >= min_confidence), "pii-sure"), BROADCAST_ROWS)
    new = places.filter("kind = ''").select("row", "start", "end", F.explode("left").alias("pattern"))
    best = F.max(F.struct("confidence", "kind")).alias("best")
    return new.join(sure, "pattern").groupBy("row", "start", "end").agg(best).select("row", F.col("best.kind").alias("kind"), "start", "end")


def _span_lists(found: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per input row: row, doc_id, base and added (arrays of start, place of kind, end) of (row, kind, start, end, is_base)."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("k")
    span = F.struct("start", "k", "end")
    lists = spans.select("row", "start", kind, "end", "is_base").groupBy("row").agg(F.collect_list(F.when(F.col("is_base"), span)).alias("base"), F.collect_list(F.when(~F.col("is_base"), span)).alias("added"))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")
    rows = found.select("row", "doc_id").join(lists, "row", "left")
    return rows.select("row", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _base_spans(places: DataFrame) -> DataFrame:
    return places.filter("kind <> ''").select("row", "kind", "start", "end", F.lit(True).alias("is_base"))


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per input row: row, doc_id, base and added (arrays of start, place of kind, end)."""
    found = find_strings(documents)
    places = positioned(found)
    added = discovered(places, confident_patterns(places)).withColumn("is_base", F.lit(False))
    return _span_lists(found, _base_spans(places).unionByName(added))


def span_digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_counts() -> list[Column]:
    """n_email, n_ip, n_card and n_phone of the base spans."""

    def count(place: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == place)).cast("long")

    return [count(k + 1).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", *kind_counts(), F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(F.concat("base", "added")).alias("spans"))


def pii_base(spark, sf_dir: str) -> DataFrame:
    """The base columns of op10 alone, which SQL can state."""
    found = find_strings(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return _span_lists(found, _base_spans(positioned(found))).select("doc_id", *kind_counts(), F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"))


def _base_sql() -> str:
    """Offsets are cumulative lengths of what the contract's patterns split and extract."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(p, 3) AS INTEGER), 999) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INTEGER WHEN d[i]::INTEGER > 4 THEN d[i]::INTEGER * 2 - 9 ELSE d[i]::INTEGER * 2 END)) % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    }
    parts = []
    for place, (kind, (pattern, holds)) in enumerate(kinds.items()):
        parts.append(f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, upto - length(hit) AS st, upto AS en FROM (
  SELECT doc_id, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS d, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (
    SELECT doc_id, unnest(range(1, len(f) + 1)) AS k, unnest(g[1:len(f)]) AS gap, unnest(f) AS hit FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS f FROM documents WHERE text IS NOT NULL))) WHERE {holds}""")
    return " UNION ALL ".join(parts)


PII_BASE_SQL = f"""WITH s AS ({_base_sql()}),
g AS (SELECT doc_id, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, place) AS spans, {", ".join(f"count_if(kind = '{k}')::BIGINT AS n_{k}" for k in BASE_KINDS)} FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)"""
