"""Phrases of large lexicons, found by an inverted index in place of one alternation.

An alternation of 100,000 phrases is tried at every place of every text. Here each phrase is filed under its rarest word
in the corpus; a text's words are looked up in that table (broadcast, behind a check of its size), and a phrase is verified by
position only where its rarest word stands. Work grows with words and true candidates, not with the lexicon.

Matches are those of :class:`lectern.functions.lexicon.Lexicon`: words are runs of letters, digits and underscores, parts of a phrase
may be inflected, white space of any kind stands between them, and other marks inside a part stand as they are. Of matches that
overlap the leftmost counts, of those that start together the longest term.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.lexicon import TOKEN, UNINFLECTED, inflects, inflections
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.scratch import stored

#: What a pattern's word boundary separates.
WORD = r"[\p{L}\p{Nd}_]++"
_WORD = re.compile(r"[^\W]+")
PHRASE = "lexicon string, phrase int, priority int, size int, forms array<array<string>>, gaps array<string>"
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20


def phrase_rows(lexicons: dict[str, Iterable[str]], inflect: bool = True) -> list[tuple]:
    """The terms of two or more words, by lexicon: each word's forms and what stands between words, longest term first."""
    rows = []
    for name, terms in sorted(lexicons.items()):
        split = {tuple(re.findall(TOKEN, t.lower())) for t in terms}
        ordered = sorted((t for t in split if len(t) > 1), key=lambda t: (-len(" ".join(t)), t))
        for priority, parts in enumerate(ordered):
            forms, gaps = [], []
            for part in parts:
                spelled = inflections(part) if inflect and inflects(part) and part not in UNINFLECTED else {part}
                words = _WORD.findall(part)
                cut = [_WORD.findall(s) for s in spelled]
                gaps += [" "] * bool(forms) + _WORD.split(part)[1:-1]
                forms += [sorted({c[k] for c in cut if len(c) == len(words)}) for k in range(len(words))]
            rows.append((name, len(rows), priority, len(forms), forms, gaps))
    return rows


@dataclass
class PhraseIndex:
    """Phrases filed under every form of their rarest word."""

    keys: DataFrame  # word, offset and the columns of PHRASE; a stored table
    longest: int


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def index_phrases(spark: SparkSession, rows: list[tuple] | DataFrame, corpus: DataFrame, text: str = "text") -> PhraseIndex:
    """File phrases (rows of PHRASE) by the corpus's own word counts, which take one pass with map-side combine."""
    phrases = stored(rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, PHRASE), "phrases")
    spelled = stored(phrases.select("lexicon", "phrase", F.posexplode("forms").alias("offset", "spelled")).select("lexicon", "phrase", "offset", F.explode("spelled").alias("word")), "phrase-words")
    vocabulary = small_or_shuffled(stored(spelled.select("word").distinct(), "phrase-vocabulary"), BROADCAST_ROWS, BROADCAST_BYTES)
    counts = corpus.select(F.explode(words_of(F.col(text))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    weight = spelled.join(counts, "word", "left").groupBy("lexicon", "phrase", "offset").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = weight.groupBy("lexicon", "phrase").agg(F.min_by("offset", F.struct("n", "offset")).alias("offset"))
    keys = spelled.join(rarest, ["lexicon", "phrase", "offset"]).join(phrases, ["lexicon", "phrase"])
    longest = phrases.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]
    return PhraseIndex(stored(keys, "phrase-keys"), longest)


def matches(documents: DataFrame, index: PhraseIndex, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lexicon, phrase, priority, start, end, found): every occurrence of every phrase, in places of words.

    A word travels with the few words around it, never with its document, and is looked up without a shuffle.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    between = F.transform(F.split(low, WORD, -1), lambda g: F.when(g.rlike(r"\A\s+\z"), " ").otherwise(g))
    reach = index.longest - 1

    def around(p: Column) -> Column:
        begin = lambda i: F.greatest(i - reach, F.lit(0))
        near = lambda a, i, shift: F.slice(a, begin(i) + 1 + shift, F.lit(2 * reach + 1))
        return F.transform(p["w"], lambda w, i: F.struct(w.alias("word"), i.alias("pos"), begin(i).alias("begin"), near(p["w"], i, 0).alias("w"), near(p["g"], i, 1).alias("g")))

    parts = F.struct(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)).alias("w"), between.alias("g"))
    places = documents.select(F.col(id_).alias("id"), F.explode(tx.let(parts, around)).alias("p")).select("id", "p.*")
    keys = small_or_shuffled(index.keys, BROADCAST_ROWS, BROADCAST_BYTES)
    met = places.join(keys, "word").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= begin")
    at = F.col("start") - F.col("begin")
    same = lambda k: F.array_contains(F.get("forms", k), F.get("w", at + k)) & ((k == 0) | (F.get("g", at + k - 1) == F.get("gaps", k - 1)))
    holds = F.forall(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.coalesce(same(k), F.lit(False)))
    found = F.array_join(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.concat(F.get("w", at + k), F.when(k < F.col("size") - 1, F.get("g", at + k)).otherwise(""))), "")
    return met.filter(holds).select("id", "lexicon", "phrase", "priority", "start", (F.col("start") + F.col("size")).alias("end"), found.alias("found"))


def phrase_hits(found: DataFrame, words: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(id, lexicon, hits, inside) of :func:`matches`: those that count, and the single words of ``words`` inside them.

    A lexicon's hits in a text are its word hits, and these hits, less ``inside``. Texts without a match have no row.
    """
    inside = F.lit(0)
    for name, some in (words or {}).items():
        inside = F.when(F.col("lexicon") == name, tx.count_tokens(tx.tokens(F.col("found")), some)).otherwise(inside)
    each = F.sort_array(F.collect_list(F.struct("start", "priority", "end", inside.alias("inside"))))
    first = F.struct(F.lit(0).alias("until"), F.lit(0).alias("hits"), F.lit(0).alias("inside"))

    def take(acc: Column, m: Column) -> Column:
        taken = F.struct(m["end"].alias("until"), (acc["hits"] + 1).alias("hits"), (acc["inside"] + m["inside"]).alias("inside"))
        return F.when(m["start"] >= acc["until"], taken).otherwise(acc)

    return found.groupBy("id", "lexicon").agg(F.aggregate(each, first, take).alias("t")).select("id", "lexicon", F.col("t.hits").alias("hits"), F.col("t.inside").alias("inside"))
