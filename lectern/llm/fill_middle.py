"""Fill-in-the-middle examples by lookaround splitting, in DataFrame functions only.

A unit grammar says which neighbouring classes of characters have a boundary between them. It is translated to one
zero-width regular expression (look behind for the left class, ahead for the right one), so that ``split`` loses
nothing: the pieces of a text, joined, are the text. Two hashed numbers choose the boundaries that cut a document into
prefix, middle and suffix; two more choose the form. A document's result depends on its key and text alone, so jobs
can be run again or in parts.

Defined results: a null text counts as empty; an empty text has no units and stays plain (``split`` would give one
empty piece, so it is handled apart). A text that holds a sentinel stays plain, as it could not be restored. A null
doc_id is replaced by the digest of the text. Rows that repeat are transformed alike, one row each. Other columns are
kept, but for those named like the result's (``COLUMNS``) or like the two working columns, which are replaced. Texts of any length are taken whole; the pieces of one
text are in one row's array, so a text needs about 60 bytes of memory a unit while it is worked on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.parallelism import spread

SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = ("fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output")


@dataclass(frozen=True)
class Grammar:
    """Boundaries of units: pairs of character classes (regular expressions of bounded length) that meet there."""

    boundaries: tuple[tuple[str, str], ...]

    def regex(self) -> str:
        """The zero-width boundary: a left class behind and a right class ahead. It never matches at the ends of a text."""
        return "(?s)" + "|".join(f"(?<={left})(?={right})" for left, right in self.boundaries)


GRAMMARS = {
    # every code point is a unit
    "char": Grammar(((".", "."),)),
    # a word with the white space behind it
    "word": Grammar(((r"\s", r"\S"),)),
    # a line with its line feed
    "line": Grammar(((r"\n", "."),)),
    # up to a full stop, question or exclamation mark and the white space behind it
    "sentence": Grammar(((r"[.!?]\s", r"\S"),)),
    # a run of word characters, a run of white space or one other character
    "token": Grammar(((r"\w", r"\W"), (r"\s", r"\S"), (r"[^\w\s]", "."))),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The pieces of a text; an empty array for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.regex(), -1))


def _numbers(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def join_form(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """The training text of a form."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "spm", spm).otherwise(psm)


def restore(output: Column, form: Column) -> Column:
    """The original text, from output and form alone."""
    mark = "<[" + "".join(m[1] for m in (PREFIX, SUFFIX, MIDDLE)) + "]>"

    def order(parts: Column) -> Column:
        first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
        return F.when(form == "spm", F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))

    return F.when(form == "plain", output).otherwise(F.element_at(F.transform(F.array(F.split(output, mark, -1)), order), 1))


def fill_in_middle(documents: DataFrame, unit: str | Grammar = "char", seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """The documents with ``COLUMNS``: units, form (plain, psm or spm), the three parts (null if plain) and the output.

    Of 100 documents those from ``plain_from`` on stay plain; of 100 others ``spm_below`` have the suffix first. No row is shuffled.
    """
    grammar = GRAMMARS[unit] if isinstance(unit, str) else unit
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(text, 256)))
    h1, h2, h3, h4 = _numbers(key, seed)
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in (*COLUMNS, "_fim_hashes", "_fim_made")]
    closed = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | (h3 % 100 >= plain_from) | closed, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    chosen = documents.select(*kept, form.alias("fim_form"), F.array(h1, h2).alias("_fim_hashes"))

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)
        ends = F.array_sort(F.transform("_fim_hashes", lambda h: (h % (n + 1)).cast("int")))
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        part = lambda start, end: F.array_join(F.slice(pieces, start + 1, end - start), "")
        parts = F.struct(part(F.lit(0), low).alias("prefix"), part(low, high).alias("middle"), part(high, n).alias("suffix"))
        return F.struct(n.cast("long").alias("n"), F.when(F.col("fim_form") != "plain", parts).alias("parts"))

    # transform() names the pieces, so that they are made once a row, not once a use
    made = F.element_at(F.transform(F.array(units(text, grammar)), cut), 1)
    cuts = chosen.select(*kept, "fim_form", made.alias("_fim_made"))
    parts = F.col("_fim_made.parts")
    output = join_form(F.col("fim_form"), parts["prefix"], parts["middle"], parts["suffix"], text)
    return cuts.select(
        *kept, F.col("_fim_made.n").alias("fim_n"), "fim_form", parts["prefix"].alias("fim_prefix"), parts["middle"].alias("fim_middle"), parts["suffix"].alias("fim_suffix"), output.alias("fim_output"),
    )


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    made = fill_in_middle(documents)
    return made.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"),
        F.length("fim_prefix").cast("long").alias("prefix_chars"), F.length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restore(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
