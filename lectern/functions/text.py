"""Tokens, lexicon counts and spans as Column expressions over lower-cased text.

Spans are arrays of struct(st, en), offsets in code points, ends exclusive. No Python runs on executors:
offsets of all matches come from the lengths of what a pattern splits and extracts.

A fold that appends to an array copies it for every element. So spans are combined by prefix scans: sums and maxima over
all elements before, in doubling steps, each of which makes one new array. Overlaps are tested on sorted events with a
running maximum, and text is cut from blocks, as a substring walks the text from its start. n spans cost n log n.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.lexicon import TOKEN, Lexicon

SPANS = "array<struct<st:int,en:int>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also if a lambda inside ``use`` reads it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def holds(text: Column, needs: Iterable[str]) -> Column:
    """Whether the text has any of these literals. They are searched as bytes, at a fraction of the cost of a pattern."""
    return functools.reduce(operator.or_, [F.contains(text, F.lit(x)) for x in needs])


def _in(word: Column, words) -> Column:
    return word.isin(*sorted(words)) if words else F.lit(False)


def count_tokens(toks: Column, words) -> Column:
    return F.size(F.filter(toks, lambda t: _in(t, words)))


def count_hits(lexicon: Lexicon, low: Column, toks: Column) -> Column:
    """Word hits plus phrase hits, less the word hits inside phrase hits."""
    words = count_tokens(toks, lexicon.words) if lexicon.words else F.lit(0)
    if not lexicon.phrases:
        return words
    if not lexicon.words:
        return F.regexp_count(low, F.lit(lexicon.phrases))
    # All matches' words are counted at once: no token crosses the blanks between them.
    added = lambda found: F.size(found) - count_tokens(tokens(F.array_join(found, " ")), lexicon.words)
    return words + let(F.regexp_extract_all(low, F.lit(lexicon.phrases), F.lit(0)), added)


def count_hits_excluding(lexicon: Lexicon, low: Column, toks: Column, exclusions: str, needs: Iterable[str] = ()) -> Column:
    """Hits less exclusion matches, never below 0; the exclusions are only looked for where there are hits.

    ``needs``: literals of which every exclusion match has one; texts without any are not searched.
    """
    excluded = F.regexp_count(low, F.lit(exclusions))
    excluded = F.when(holds(low, needs), excluded).otherwise(0) if needs else excluded
    return let(count_hits(lexicon, low, toks), lambda hits: F.when(hits > 0, F.greatest(F.lit(0), hits - excluded)).otherwise(0))


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix scan of an array without nulls: element i is all of 0 .. i, combined by an associative function."""

    def double(acc: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= reach, combine(F.get(acc, i - reach), x)).otherwise(x))

    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1), v, double)))


def running_sum(values: Column) -> Column:
    return scan(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return scan(values, F.greatest)


BLOCK = 1_024


class Blocks:
    """A text in blocks of ``BLOCK`` code points, to cut pieces from it at the cost of the pieces. Use it inside :func:`in_blocks`."""

    def __init__(self, blocks: Column):
        self.blocks = blocks

    def piece(self, start: Column, size: Column) -> Column:
        """``size`` code points from ``start`` (from 0), as many as there are."""
        first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + size - 1) / BLOCK).cast("int")
        near = F.array_join(F.slice(self.blocks, first + 1, last - first + 1), "")
        return F.when(size > 0, F.substring(near, start - first * BLOCK + 1, size)).otherwise("")


def in_blocks(text: Column, use: Callable[[Blocks], Column]) -> Column:
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda b: use(Blocks(b)))


def match_spans(text: Column, pattern: str, needs: Iterable[str] = ()) -> Column:
    """Spans of all matches of a pattern that never matches the empty string; each match has one of the literals ``needs``, if given."""
    if not pattern:
        return no_spans()
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    pairs = F.filter(F.zip_with(gaps, lengths, lambda g, n: F.struct((g + n).alias("step"), n.alias("n"))), lambda p: p["n"].isNotNull())
    placed = lambda p: F.zip_with(p, running_sum(F.transform(p, lambda x: x["step"])), lambda x, en: F.struct((en - x["n"]).alias("st"), en.alias("en")))
    some = holds(text, needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(some, let(pairs, placed)).otherwise(no_spans())  # most texts have no match: one pass, nothing made


def token_pattern(words) -> str:
    """Matches exactly the tokens in ``words``: no letter, digit or joined part before or after. First letters are looked at first, as that is cheap."""
    quote = lambda w: re.sub(r"([^A-Za-z0-9_’])", r"\\\1", w)
    joined = "|".join(sorted(map(quote, words), key=lambda w: (-len(w), w)))
    first = "".join(sorted({quote(w[0]) for w in words}))
    return rf"(?=[{first}])(?<![a-z0-9])(?<![a-z0-9][-'’])(?:{joined})(?![a-z0-9])(?![-'’][a-z0-9])"


def token_spans(text: Column, words, needs: Iterable[str] = ()) -> Column:
    """Spans of the tokens in ``words``."""
    return match_spans(text, token_pattern(words), needs) if words else no_spans()


def _swept(spans: Column, others: Column, at: str, others_first: bool, keep: Callable[[Column, Column], Column]) -> Column:
    """The spans, in order, for which ``keep(span, reach)`` holds: ``reach`` is the largest end of the others that start before.

    Before means before the span's ``at`` (or at it, if ``others_first``). Both arrays become one array of events, sorted by place.
    """
    none = F.lit(-1)
    event = lambda key, turn, st, en, other: F.struct(key.alias("key"), F.lit(turn).alias("turn"), st.alias("st"), en.alias("en"), other.alias("other"))
    theirs = F.transform(others, lambda o: event(o["st"], 0 if others_first else 2, none, none, o["en"]))
    ours = F.transform(spans, lambda s: event(s[at], 1, s["st"], s["en"], none))

    def sweep(events: Column) -> Column:
        reach = running_max(F.transform(events, lambda e: e["other"]))
        joined = F.zip_with(events, reach, lambda e, r: F.struct(e["st"].alias("st"), e["en"].alias("en"), r.alias("reach")))
        kept = F.filter(joined, lambda e: (e["st"] >= 0) & keep(e, e["reach"]))
        return F.array_sort(F.transform(kept, lambda e: F.struct(e["st"].alias("st"), e["en"].alias("en"))))

    return let(F.array_sort(F.concat(ours, theirs)), sweep)


def lexicon_spans(lexicon: Lexicon, text: Column) -> Column:
    """Phrase spans and the word spans that no phrase span contains, in order."""
    phrases = match_spans(text, lexicon.phrases)
    words = token_spans(text, lexicon.words)
    if not lexicon.phrases:
        return words
    if not lexicon.words:
        return phrases
    # Phrase matches are disjoint, so the one that reaches furthest is the one that started last.
    alone = lambda both: _swept(both["w"], both["p"], "st", True, lambda w, reach: w["en"] > reach)
    both = lambda b: F.when(F.size(b["p"]) == 0, b["w"]).when(F.size(b["w"]) == 0, b["p"]).otherwise(F.array_sort(F.concat(b["p"], alone(b))))
    return let(F.struct(phrases.alias("p"), words.alias("w")), both)


def without_overlaps(spans: Column, text: Column, exclusions: str, needs: Iterable[str] = ()) -> Column:
    """The spans that overlap no exclusion match; each of those has one of the literals ``needs``, if given."""
    clear = lambda b: _swept(b["s"], b["x"], "en", False, lambda s, reach: reach <= s["st"])
    both = lambda b: F.when((F.size(b["s"]) == 0) | (F.size(b["x"]) == 0), b["s"]).otherwise(clear(b))
    return let(F.struct(spans.alias("s"), match_spans(text, exclusions, needs).alias("x")), both)


def merge_spans(spans: Column, touching: bool = False) -> Column:
    """Union of overlapping spans; spans that only touch merge if ``touching``."""

    def merge(ordered: Column) -> Column:
        reach = running_max(F.transform(ordered, lambda s: s["en"]))
        return let(F.struct(ordered.alias("s"), reach.alias("reach")), united)

    def united(b: Column) -> Column:
        def begins(s: Column, i: Column) -> Column:
            before = F.get(b["reach"], i - 1)
            return F.when(i == 0, True).otherwise((s["st"] > before) if touching else (s["st"] >= before))

        heads = F.filter(F.transform(b["s"], lambda s, i: F.struct(s["st"].alias("st"), i.alias("i"), begins(s, i).alias("head"))), lambda x: x["head"])
        ends = lambda h: F.transform(h, lambda x, k: F.struct(x["st"].alias("st"), F.get(b["reach"], F.coalesce(F.get(h, k + 1)["i"], F.size(b["s"])) - 1).alias("en")))
        return let(heads, ends)

    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(let(F.array_sort(s), merge)))


def unnegated(spans: Column, text: Column, negation: str, coordination: str, look_back: int = 80) -> Column:
    """Spans that are not negated: no negation ends just before them, nor do they continue a negated one.

    ``negation`` must match the end of the ``look_back`` characters before a span; ``coordination`` must match
    all between the last negated span and this one. An accepted span ends the chain: a span is negated if the last
    directly negated one up to it comes no earlier than the last place where a chain broke.
    """

    def judge(all_spans: Column) -> Column:
        def mark(b: Blocks) -> Column:
            def of(s: Column, i: Column) -> Column:
                before = b.piece(F.greatest(s["st"] - look_back, F.lit(0)), F.least(s["st"], F.lit(look_back)))
                last = F.get(all_spans, i - 1)["en"]
                between = F.when(i > 0, b.piece(last, s["st"] - last))
                direct, joined = before.rlike(negation), F.coalesce(between.rlike(coordination), F.lit(False))
                return F.struct(F.when(direct, i).otherwise(-1).alias("direct"), F.when(joined, -1).otherwise(i).alias("broken"))

            return F.transform(all_spans, of)

        def clear(marks: Column) -> Column:
            last = F.struct(running_max(F.transform(marks, lambda m: m["direct"])).alias("direct"), running_max(F.transform(marks, lambda m: m["broken"])).alias("broken"))
            return let(last, lambda m: F.filter(all_spans, lambda s, i: F.get(m["direct"], i) < F.get(m["broken"], i)))

        return let(in_blocks(text, mark), clear)

    return let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(judge(s)))


def window_text(text: Column, spans: Column, radius: int = 200) -> Column:
    """Text within ``radius`` of any span; separate windows are joined by a mark that no phrase crosses."""
    around = F.transform(spans, lambda s: F.struct(F.greatest(s["st"] - radius, F.lit(0)).alias("st"), F.least(s["en"] + radius, F.length(text)).alias("en")))
    windows = lambda w: in_blocks(text, lambda b: F.array_join(F.transform(w, lambda s: b.piece(s["st"], s["en"] - s["st"])), " \x1e "))
    return F.when(F.size(spans) == 0, "").otherwise(let(merge_spans(around, touching=True), windows))


def span_contexts(text: Column, spans: Column, radius: int = 300) -> Column:
    """For each span the clause around it: to the nearest of ``.!?;`` or line end, within ``radius``."""

    def in_text(b: Blocks) -> Column:
        def context(s: Column) -> Column:
            left = b.piece(F.greatest(s["st"] - radius, F.lit(0)), F.least(s["st"], F.lit(radius)))
            right = b.piece(s["en"], F.lit(radius))
            return F.concat(
                F.regexp_extract(left, r"[^.!?;\n]*\z", 0), b.piece(s["st"], s["en"] - s["st"]), F.regexp_extract(right, r"\A[^.!?;\n]*[.!?;\n]?", 0)
            )

        return F.transform(spans, context)

    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(in_blocks(text, in_text))


def mask_quotes(text: Column, opening: str = "``", closing: str = "''", cap: int = 4000) -> tuple[Column, Column]:
    """(spoken, quoted): quoted regions blanked to equal length, and their inner texts joined by a space."""
    q = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
    pattern = rf"(?s){q(opening)}(.{{0,{cap}}}?){q(closing)}"
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blanks = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_join(blanks, ""), F.array_join(inner, " ")
