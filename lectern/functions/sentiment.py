"""Compound sentiment of sentences by a rule-based valence method (Hutto and Gilbert, 2014), as array expressions.

A word's valence, from the user's lexicon, is raised by capitals, raised or lowered by degree words up to three words before
it, turned by negators among the same three words, and reweighted around a contrasting ``but``. A sentence's sum, with the
emphasis of its marks, is squashed to -1 .. 1. Means over sentences weigh each sentence alike. Idioms and emoticon tables are
not built in; they are entries of the lexicon. Values are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.scoring import sentences
from lectern.functions.text import let

# Fixed values of the published method: increments of degree words and capitals, weight by distance, factor of a negator,
# weights before and after the contrast, emphasis of marks, and the squashing constant.
DEGREE, CAPITALS, NEGATED = 0.293, 0.733, -0.74
NEARNESS = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.292, 4, 0.18, 3, 0.96
SCALE = 15.0
PUNCTUATION = r"!-/:-@\[-`{-~"


@dataclass(frozen=True)
class Valences:
    """The user's words: valences, degree words (1 raises, -1 lowers) and negators, all in lower case."""

    words: dict[str, float]
    degrees: dict[str, int] = field(default_factory=dict)
    negators: frozenset[str] = frozenset({"not", "no", "never", "without", "cannot", "nor", "neither"})


def _looked_up(table: dict[str, float], word: Column) -> Column:
    """The word's value, or null: a hash set first, as a map literal is searched entry by entry."""
    if not table:
        return F.lit(None).cast("double")
    entries = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
    return F.when(word.isin(*sorted(table)), F.try_element_at(entries, word))


def words_of(sentence: Column) -> Column:
    """Runs between white space; punctuation around a word goes, unless two characters or fewer would be left."""
    bare = lambda t: F.regexp_replace(t, rf"\A[{PUNCTUATION}]++|(?<![{PUNCTUATION}])[{PUNCTUATION}]++\z", "")
    return F.transform(F.regexp_extract_all(sentence, F.lit(r"(\S++)"), F.lit(1)), lambda t: F.when(F.length(bare(t)) > 2, bare(t)).otherwise(t))


def _tokens(words: Column, v: Valences) -> Column:
    def token(w: Column) -> Column:
        low = F.lower(w)
        negates = low.isin(*sorted(v.negators)) | F.endswith(low, F.lit("n't")) if v.negators else F.endswith(low, F.lit("n't"))
        return F.struct(
            low.alias("low"), ((F.upper(w) == w) & (low != w)).alias("loud"), _looked_up(v.words, low).alias("valence"),
            (_looked_up({k: float(d) for k, d in v.degrees.items()}, low) * DEGREE).alias("degree"), negates.alias("negates"),
        )

    return F.transform(words, token)


def valences(tokens: Column) -> Column:
    """The valence of each token in its place; 0 where it has none."""

    def all_of(s: Column) -> Column:
        t, mixed = s["t"], s["mixed"]

        def sign(x: Column) -> Column:
            return F.when(x > 0, 1.0).otherwise(-1.0)

        def modified(value: Column, before: Column, nearness: float) -> Column:
            push = (F.coalesce(before["degree"], F.lit(0.0)) + F.when(before["degree"].isNotNull() & before["loud"] & mixed, CAPITALS).otherwise(0.0)) * sign(value)
            shifted = value + push * nearness
            turned = F.when(before["negates"], shifted * NEGATED).otherwise(shifted)
            return F.when(before.isNotNull() & before["valence"].isNull(), turned).otherwise(value)

        def of(x: Column, i: Column) -> Column:
            value = x["valence"] + F.when(x["loud"] & mixed, sign(x["valence"]) * CAPITALS).otherwise(0.0)
            for k, nearness in enumerate(NEARNESS, 1):
                value = modified(value, F.get(t, i - k), nearness)
            weight = F.when((s["but"] == 0) | (i == s["but"] - 1), 1.0).when(i < s["but"] - 1, BEFORE_BUT).otherwise(AFTER_BUT)
            return F.when(x["valence"].isNull(), 0.0).otherwise(value * weight)

        return F.transform(t, of)

    loud = lambda t: F.size(F.filter(t, lambda x: x["loud"]))
    seen = lambda t: F.struct(t.alias("t"), ((loud(t) > 0) & (loud(t) < F.size(t))).alias("mixed"), F.array_position(F.transform(t, lambda x: x["low"]), "but").alias("but"))
    return let(tokens, lambda t: let(seen(t), all_of))


def emphasis(sentence: Column) -> Column:
    calls, asks = F.regexp_count(sentence, F.lit("!")), F.regexp_count(sentence, F.lit(r"\?"))
    asked = F.when(asks <= 1, 0.0).when(asks <= MOST_QUESTIONS, asks * QUESTION).otherwise(MANY_QUESTIONS)
    return F.least(calls, F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + asked


def sentence_scores(sentence: Column, v: Valences) -> Column:
    """struct(value, below): the compound value of a sentence and the negative share of its words."""

    def score(x: Column) -> Column:
        total = lambda keep, f: F.aggregate(F.filter(x["v"], keep), F.lit(0.0), lambda n, y: n + f(y))
        plain = total(lambda y: y != 0, lambda y: y)
        push = x["e"]
        raised = F.when(plain > 0, plain + push).when(plain < 0, plain - push).otherwise(0.0)
        up, down = total(lambda y: y > 0, lambda y: y + 1), total(lambda y: y < 0, lambda y: 1 - y)
        neutral = F.size(F.filter(x["v"], lambda y: y == 0))
        up_, down_ = F.when(up > down, up + push).otherwise(up), F.when(down > up, down + push).otherwise(down)
        return F.struct((raised / F.sqrt(raised * raised + SCALE)).alias("value"), F.coalesce(F.try_divide(down_, up_ + down_ + neutral), F.lit(0.0)).alias("below"))

    return let(F.struct(valences(_tokens(words_of(sentence), v)).alias("v"), emphasis(sentence).alias("e")), score)


def compound_sentiment(v: Valences) -> Callable[[Column], Column]:
    """A sentiment for :func:`lectern.functions.scoring.score_turns`: means over the sentences that are not blank, and their number."""

    def sentiment(text: Column) -> Column:
        each = F.transform(F.filter(sentences(F.coalesce(text, F.lit(""))), lambda s: s.rlike(r"\S")), lambda s: sentence_scores(s, v))

        def means(e: Column) -> Column:
            mean = lambda f: F.coalesce(F.try_divide(F.aggregate(e, F.lit(0.0), lambda n, x: n + x[f]), F.size(e)), F.lit(0.0))
            return F.struct(mean("value").alias("sentiment"), mean("below").alias("neg_share"), F.size(e).cast("long").alias("n_sentences"))

        return let(each, means)

    return sentiment
