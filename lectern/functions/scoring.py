"""Turn scores: nine lexicon roles to a set of count columns."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.lexicon import Lexicon, compile_tiers

# Names of the other party by the speaker's, exclusion and negation patterns.
OTHER_PARTY_WORDS = {"D": ("republicans", "gop"), "R": ("democrat", "democrats")}
OTHER_PARTY_PHRASES = {
    "D": r"\brepublican\s+(?:party|colleagues?|members?|caucus|leadership|side|conference)\b",
    "R": r"\bdemocratic\s+(?:party|colleagues?|members?|caucus|leadership|side|conference)\b",
}
PARTY_LABEL_WORD, PARTY_LABEL = "democrat", r"\bdemocrat\s+party\b"
COOPERATION_EXCLUSIONS = r"\bin a bipartisan\s+(?:board|commission|committee)\b"
HOSTILITY_EXCLUSIONS = (
    r"\bphony\s+(?:price|expense)\b"
    r"|\b(?:mental|legal)\s+incompetents?\b"
    r"|\bnot\s+(?:a\s+)?(?:coward|cowardly|liar|incompetent)\b"
    r"|\b(?:was|is)\s+(?:\w+\s+){0,4}a\s+liar\?"
)
MISCONDUCT_EXCLUSIONS = (
    r"\bforeign\s+corrupt\s+practices\s+act\b"
    r"|\b(?:no|not|without)\s+(?:evidence\s+of\s+)?(?:corrupt|corruption)\b"
    r"|\bdo\s+not\s+believe\s+there\s+is\s+corruption\b"
)
NEGATION = (
    r"\b(?:no|not|without)"
    r"(?:\s+(?:any|credible|clear|direct|actual))?"
    r"(?:\s+(?:evidence|proof|finding|findings|sign|signs|allegation|allegations))?"
    r"(?:\s+of)?\s+\z"
    r"|\bnot\s+guilty\s+of\s+\z"
)
COORDINATION = r"\A\s*(?:,\s*)?(?:or|and)\s*\z"
MILD_EXCLUSIONS = (
    r"\bto\s+damn\s+them\b"
    r"|\bbe\s+damned\s+and\s+annulled\b"
    r"|\block\s+and\s+damn\b"
    r"|\bkilled\s+a\s+damn\s+in\b"
    r"|\bmy\s+damn\s+sin\b"
    r"|\bcrap\s+game\b"
)
# Literals of which every match of a fixed pattern has at least one.
OTHER_PARTY_NEEDS = {"D": ("republican",), "R": ("democratic",)}
COOPERATION_NEEDS = ("in a bipartisan",)
HOSTILITY_NEEDS = ("phony", "incompetent", "coward", "liar")
MISCONDUCT_NEEDS = ("corrupt",)
MILD_NEEDS = ("damn", "crap")


@dataclass(frozen=True)
class Scorer:
    """The nine lexicon roles. Word lists are the user's; :meth:`sample` has small neutral ones."""

    courtesy: Lexicon
    gratitude: Lexicon
    cooperation: Lexicon
    hostility: Lexicon
    misconduct: Lexicon
    labels: Lexicon
    idioms: Lexicon
    profanity: dict[str, Lexicon] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.courtesy, self.gratitude, self.cooperation, self.hostility, self.misconduct, self.labels, self.idioms, *sorted(self.profanity.items(), key=lambda x: x[0])))

    @classmethod
    def compile(cls, terms: dict[str, list[str]], tiers: list[str], slurs: list[str], inflect: bool = True) -> Scorer:
        fuzzy = {k: Lexicon.compile(terms.get(k, []), inflect) for k in ("courtesy", "gratitude", "cooperation", "hostility", "labels", "idioms")}
        return cls(misconduct=Lexicon.compile(terms.get("misconduct", []), False), profanity=compile_tiers(tiers, slurs), **fuzzy)

    @classmethod
    def sample(cls) -> Scorer:
        return cls.compile(
            {
                "courtesy": ["my good friend", "distinguished colleague", "gentleman"],
                "gratitude": ["thank my colleague", "deep appreciation"],
                "cooperation": ["bipartisan", "reach across the aisle"],
                "hostility": ["coward", "liar", "shameful conduct"],
                "misconduct": ["bribery", "corrupt", "abuse of office"],
                "labels": ["radical", "far left"],
                "idioms": ["other side of the aisle"],
            },
            ["damn\tmild", "crap\tmild", "hellish mess\tstrong"],
            [],
        )

    def outgroup_spans(self, low: Column, party: Column) -> Column:
        """References to the other party: idioms for all, names and phrases by the speaker's party; merged."""
        idioms = tx.match_spans(low, self.idioms.phrases)

        def of(p: str) -> Column:
            return tx.merge_spans(F.concat(idioms, tx.token_spans(low, OTHER_PARTY_WORDS[p], OTHER_PARTY_WORDS[p]), tx.match_spans(low, OTHER_PARTY_PHRASES[p], OTHER_PARTY_NEEDS[p])))

        return F.when(party == "D", of("D")).when(party == "R", of("R")).otherwise(tx.merge_spans(idioms))

    def misconduct_spans(self, text: Column, toks: Column | None = None) -> Column:
        """Accepted misconduct spans. With the text's tokens, texts without any term skip the span work."""
        spans = tx.without_overlaps(tx.lexicon_spans(self.misconduct, text), text, MISCONDUCT_EXCLUSIONS, MISCONDUCT_NEEDS)
        spans = tx.unnegated(spans, text, NEGATION, COORDINATION)
        if toks is None:
            return spans
        some = tx.count_tokens(toks, self.misconduct.words) > 0
        if self.misconduct.phrases:
            some = some | text.rlike(self.misconduct.phrases)
        return F.when(some, spans).otherwise(tx.no_spans())

    def comity(self, text: Column, toks: Column) -> Column:
        return (
            tx.count_hits(self.courtesy, text, toks)
            + tx.count_hits(self.gratitude, text, toks)
            + tx.count_hits_excluding(self.cooperation, text, toks, COOPERATION_EXCLUSIONS, COOPERATION_NEEDS)
        )

    def attack(self, text: Column, toks: Column) -> Column:
        return tx.count_hits_excluding(self.hostility, text, toks, HOSTILITY_EXCLUSIONS, HOSTILITY_NEEDS)

    def profanity_counts(self, low: Column, toks: Column) -> dict[str, Column]:
        """Hits of the mild tier, less its exclusions, and of the strong tier."""
        return {
            "profanity_mild": tx.count_hits_excluding(self.profanity["mild"], low, toks, MILD_EXCLUSIONS, MILD_NEEDS),
            "profanity_strong": tx.count_hits(self.profanity["strong"], low, toks),
        }

    def signal_spans(self, low: Column, party: Column) -> dict[str, Column]:
        """Accepted spans of each signal, for sampling."""
        clean = lambda lex, exclusions, needs: tx.without_overlaps(tx.lexicon_spans(lex, low), low, exclusions, needs)
        return {
            "formal_courtesy": tx.lexicon_spans(self.courtesy, low),
            "gratitude_praise": tx.lexicon_spans(self.gratitude, low),
            "cooperation": clean(self.cooperation, COOPERATION_EXCLUSIONS, COOPERATION_NEEDS),
            "personal_attack": clean(self.hostility, HOSTILITY_EXCLUSIONS, HOSTILITY_NEEDS),
            "misconduct_allegation": self.misconduct_spans(low),
            "profanity": F.array_sort(F.concat(clean(self.profanity["mild"], MILD_EXCLUSIONS, MILD_NEEDS), tx.lexicon_spans(self.profanity["strong"], low))),
            "identity_slur": tx.lexicon_spans(self.profanity["slurs"], low),
            "outparty_target": self.outgroup_spans(low, party),
        }

    def words(self) -> frozenset[str]:
        """Every single word that any lexicon counts, and the party label."""
        lexicons = [self.courtesy, self.gratitude, self.cooperation, self.hostility, self.misconduct, self.labels, self.idioms, *self.profanity.values()]
        return frozenset({PARTY_LABEL_WORD}.union(*(x.words for x in lexicons)))

    def any_signal(self) -> str:
        """One pattern that every text with a signal matches: a cheap filter before the exact work."""
        lexicons = [self.courtesy, self.gratitude, self.cooperation, self.hostility, self.misconduct, self.idioms, *self.profanity.values()]
        parts = [x.phrases for x in lexicons if x.phrases] + sorted({w for x in lexicons for w in x.words})
        return "|".join([*parts, *(w for ws in OTHER_PARTY_WORDS.values() for w in ws), *OTHER_PARTY_PHRASES.values()])


#: Score columns in order.
SCORES = (
    "formal_courtesy_hits", "gratitude_praise_hits", "cooperation_hits", "hostility_hits", "misconduct_hits", "profanity_hits",
    "comity_hits", "ideological_label_hits", "profanity_mild", "profanity_strong", "profanity_slurs", "outgroup_refs",
    "democrat_party_pej", "directed_comity_hits", "directed_hostility_hits", "directed_misconduct_hits",
    "outgroup_comity_contexts", "outgroup_hostility_contexts", "outgroup_misconduct_contexts",
)


@functools.lru_cache(maxsize=32)
def _steps(scorer: Scorer, text: str, party: str) -> tuple[dict[str, Column], ...]:
    """Columns to add, step by step. Building thousands of expression nodes takes seconds, so they are kept by scorer."""
    low, tok, win, wtok = map(F.col, ("_low", "_tok", "_win", "_wtok"))
    # Counting only needs the tokens that some lexicon has: one pass over all tokens, short arrays after it.
    known = lambda toks: F.filter(toks, lambda t: t.isin(*sorted(scorer.words())))
    contexts = lambda hit: F.size(F.filter("_ctx", hit))
    made = {
        "formal_courtesy_hits": tx.count_hits(scorer.courtesy, low, tok),
        "gratitude_praise_hits": tx.count_hits(scorer.gratitude, low, tok),
        "cooperation_hits": tx.count_hits_excluding(scorer.cooperation, low, tok, COOPERATION_EXCLUSIONS, COOPERATION_NEEDS),
        "hostility_hits": scorer.attack(low, tok),
        "misconduct_hits": F.size(scorer.misconduct_spans(low, tok)),
        "ideological_label_hits": tx.count_hits(scorer.labels, low, tok),
        **scorer.profanity_counts(low, tok),
        "profanity_slurs": tx.count_hits(scorer.profanity["slurs"], low, tok),
        "outgroup_refs": F.size("_ref"),
        "democrat_party_pej": F.when(F.array_contains(tok, PARTY_LABEL_WORD), F.regexp_count(low, F.lit(PARTY_LABEL))).otherwise(0),
        "directed_comity_hits": scorer.comity(win, wtok),
        "directed_hostility_hits": scorer.attack(win, wtok),
        "directed_misconduct_hits": F.size(scorer.misconduct_spans(win, wtok)),
        "outgroup_comity_contexts": contexts(lambda x: scorer.comity(x["c"], x["t"]) > 0),
        "outgroup_hostility_contexts": contexts(lambda x: scorer.attack(x["c"], x["t"]) > 0),
        "outgroup_misconduct_contexts": contexts(lambda x: F.size(scorer.misconduct_spans(x["c"], x["t"])) > 0),
    }
    return (
        {"_low": F.lower(F.coalesce(F.col(text), F.lit("")))},
        {"_tok": tx.tokens(low), "_ref": scorer.outgroup_spans(low, F.coalesce(party, F.lit("other")))},
        {"_win": tx.window_text(low, F.col("_ref")), "_ctx": tx.span_contexts(low, F.col("_ref")), "n_words": F.size("_tok").cast("long"), "_tok": known(tok)},
        {"_wtok": known(tx.tokens(win)), "_ctx": F.transform("_ctx", lambda c: F.struct(c.alias("c"), known(tx.tokens(c)).alias("t")))},
        {k: v.cast("long") for k, v in made.items()},
        {"comity_hits": F.col("formal_courtesy_hits") + F.col("gratitude_praise_hits") + F.col("cooperation_hits"), "profanity_hits": F.col("profanity_mild") + F.col("profanity_strong")},
    )


def score_turns(turns: DataFrame, scorer: Scorer, text: str = "text", party: str = "party", sentiment: Callable[[Column], Column] | None = None) -> DataFrame:
    """``turns`` with ``n_words`` and the columns of ``SCORES``; a null text scores as empty.

    Lower-cased text, tokens, spans and windows are made in successive projections, so that each is computed
    once. ``sentiment`` maps a text column to struct(sentiment, neg_share, n_sentences) and adds those columns.
    Give a small scan :func:`lectern.plans.parallelism.spread` first.
    """
    base, d = list(turns.columns), turns
    for step in _steps(scorer, text, party):
        d = d.withColumns(step)
    if sentiment is None:
        return d.select(*base, "n_words", *SCORES)
    return d.withColumn("_s", sentiment(F.col(text))).select(*base, "n_words", *SCORES, "_s.*")


def polarity_sentiment(valence: dict[str, float], negators: tuple[str, ...] = ("not", "no", "never"), scale: float = 15.0) -> Callable[[Column], Column]:
    """A sentiment for :func:`score_turns` from a word list with valences; the list is the user's.

    A sentence's value is the sum of its words' valences, each turned if a negator stands right before it, squashed to
    -1 .. 1 by x / sqrt(x^2 + scale); its negative share is the share of its valued words below 0. Both are means over
    sentences; a text without sentences has 0, 0 and no sentences.
    """
    table = F.create_map(*[F.lit(x) for word, v in sorted(valence.items()) for x in (word, float(v))])

    def of_sentence(s: Column) -> Column:
        toks = tx.tokens(F.lower(s))
        values = F.transform(toks, lambda t, i: F.coalesce(F.try_element_at(table, t), F.lit(0.0)) * F.when(F.coalesce(F.get(toks, i - 1).isin(*negators), F.lit(False)), -1.0).otherwise(1.0))
        valued = F.filter(values, lambda v: v != 0)
        total = F.aggregate(valued, F.lit(0.0), lambda n, v: n + v)
        below = F.size(F.filter(valued, lambda v: v < 0))
        return F.struct((total / F.sqrt(total * total + scale)).alias("value"), F.coalesce(F.try_divide(below, F.size(valued)), F.lit(0.0)).alias("below"))

    def sentiment(text: Column) -> Column:
        each = F.transform(sentences(F.coalesce(text, F.lit(""))), of_sentence)
        mean = lambda f: F.coalesce(F.try_divide(F.aggregate(each, F.lit(0.0), lambda n, x: n + x[f]), F.size(each)), F.lit(0.0))
        return F.struct(mean("value").alias("sentiment"), mean("below").alias("neg_share"), F.size(each).cast("long").alias("n_sentences"))

    return sentiment


def sentences(text: Column) -> Column:
    """Sentences: split at white space after ``.``, ``!`` or ``?``; blank ones are left out."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
