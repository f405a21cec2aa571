"""DuckDB SQL of the turn scores: spans by cumulative lengths, merges and negation chains by window functions."""

from __future__ import annotations

from lectern.functions import scoring as sc
from lectern.functions.lexicon import Lexicon
from lectern.operators.metrics import METRICS

TOKEN_SQL = r"[a-z0-9]+(?:[-''’][a-z0-9]+)*"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def spans(source: str, keys: str, pattern: str) -> str:
    """(keys, k, hit, st, en) of all matches of a quoted pattern in column ``s`` of ``source``."""
    return f"""SELECT {keys}, k, hit, (upto - length(hit))::BIGINT AS st, upto::BIGINT AS en FROM (
  SELECT {keys}, k, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY {keys} ORDER BY k) AS upto FROM (
    SELECT {keys}, unnest(range(1, len(f) + 1)) AS k, unnest(g[1:len(f)]) AS gap, unnest(f) AS hit FROM (
      SELECT {keys}, string_split_regex(s, '{pattern}') AS g, regexp_extract_all(s, '{pattern}') AS f FROM {source})))"""


def merged(source: str, keys: str, touching: bool) -> str:
    """(keys, st, en): the union of overlapping spans, and of touching ones if asked for."""
    apart = ">" if touching else ">="
    return f"""SELECT {keys}, min(st) AS st, max(en) AS en FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN st {apart} coalesce(max(en) OVER (PARTITION BY {keys} ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM {source}))
GROUP BY {keys}, g"""


def unnegated(source: str, texts: str, keys: str, negation: str, coordination: str) -> str:
    """The spans of ``source`` that no negation stands before and that do not continue a negated one."""
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {keys}, st, en FROM (
  SELECT *, bool_or(near) OVER (PARTITION BY {keys}, g ORDER BY st ROWS UNBOUNDED PRECEDING) AS negated FROM (
    SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY st ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT {own}, st, en, regexp_matches(substr(s, greatest(st - 80, 0) + 1, least(st, 80)), '{negation}') AS near,
             coalesce(regexp_matches(substr(s, before + 1, st - before), '{coordination}'), false) AS joined
      FROM (SELECT *, lag(en) OVER (PARTITION BY {keys} ORDER BY st) AS before FROM {source}) x JOIN {texts} y ON {on})))
WHERE NOT negated"""


def one_of(words) -> str:
    return "(" + ", ".join(f"'{quoted(w)}'" for w in sorted(words)) + ")" if words else "('')"


def count(lexicon: Lexicon) -> str:
    """Hits of a lexicon in column ``s`` with tokens ``t``."""
    words = f"len(list_filter(t, lambda x: x IN {one_of(lexicon.words)}))"
    if not lexicon.phrases:
        return words
    found = f"regexp_extract_all(s, '{quoted(lexicon.phrases)}')"
    inside = f"coalesce(list_sum(list_transform({found}, lambda m: len(list_filter(regexp_extract_all(m, '{TOKEN_SQL}'), lambda x: x IN {one_of(lexicon.words)})))), 0)"
    return f"({words} + len({found}) - {inside})"


def less(lexicon: Lexicon, exclusions: str) -> str:
    return f"greatest(0, {count(lexicon)} - len(regexp_extract_all(s, '{quoted(exclusions)}')))"


def windows(keys: str, texts: str, refs: str) -> str:
    """(keys, s): the text within 200 characters of any reference; separate windows are joined by a mark."""
    return f"""SELECT {keys}, string_agg(substr(s, st + 1, en - st), ' ' || chr(30) || ' ' ORDER BY st) AS s FROM (
  {merged(f"(SELECT {keys}, greatest(st - 200, 0) AS st, least(en + 200, length(s)) AS en FROM {refs} JOIN {texts} USING ({keys}))", keys, True)}) w JOIN {texts} USING ({keys}) GROUP BY {keys}"""


def contexts(keys: str, texts: str, refs: str) -> str:
    """(keys, st, s): the clause around each reference."""
    left, right = r"[^.!?;\n]*\z", r"\A[^.!?;\n]*[.!?;\n]?"
    return f"""SELECT {keys}, st, regexp_extract(substr(s, greatest(st - 300, 0) + 1, least(st, 300)), '{left}') || substr(s, st + 1, en - st)
  || regexp_extract(substr(s, en + 1, 300), '{right}') AS s FROM {refs} JOIN {texts} USING ({keys})"""


def score_ctes(scorer: sc.Scorer, turns: str = "turns") -> str:
    """CTEs that end in ``scores``: doc_id, n_words and all score columns for the rows of ``turns``."""
    party = [f"SELECT doc_id, st, en FROM named WHERE party = '{p}' AND hit IN {one_of(w)}" for p, w in sc.OTHER_PARTY_WORDS.items()]
    party += [f"SELECT doc_id, st, en FROM ({spans(f'''(SELECT * FROM low WHERE party = '{p}')''', 'doc_id', quoted(x))})" for p, x in sc.OTHER_PARTY_PHRASES.items()]
    key, pick = "doc_id, kind, i", lambda kind, what: f"coalesce(sum({what}) FILTER (WHERE kind = '{kind}'), 0)::BIGINT"
    some = lambda what: f"count_if(kind = 'ctx' AND {what} > 0)::BIGINT"
    mild, strong, slurs = (scorer.profanity[k] for k in ("mild", "strong", "slurs"))
    return f"""low AS (SELECT doc_id, party, lower(coalesce(text, '')) AS s FROM {turns}),
named AS (SELECT * FROM ({spans("low", "doc_id", TOKEN_SQL)}) JOIN low USING (doc_id)),
found AS (SELECT doc_id, st, en FROM ({spans("low", "doc_id", quoted(scorer.idioms.phrases))}) UNION ALL {" UNION ALL ".join(party)}),
refs AS ({merged("found", "doc_id", False)}),
strings AS (SELECT doc_id, 'low' AS kind, 0::BIGINT AS i, s FROM low UNION ALL SELECT doc_id, 'win', 0, s FROM ({windows("doc_id", "low", "refs")}) UNION ALL SELECT doc_id, 'ctx', st, s FROM ({contexts("doc_id", "low", "refs")})),
blocked AS ({spans("strings", key, quoted(sc.MISCONDUCT_EXCLUSIONS))}),
accused AS (SELECT {key}, st, en FROM ({spans("strings", key, TOKEN_SQL)}) a WHERE hit IN {one_of(scorer.misconduct.words)}
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.doc_id = a.doc_id AND b.kind = a.kind AND b.i = a.i AND a.st < b.en AND b.st < a.en)),
misconduct AS (SELECT {key}, count(*) AS misconduct FROM ({unnegated("accused", "strings", key, quoted(sc.NEGATION), quoted(sc.COORDINATION))}) GROUP BY {key}),
counted AS (SELECT {key}, len(t) AS n_words, {count(scorer.courtesy)} AS courtesy, {count(scorer.gratitude)} AS gratitude, {less(scorer.cooperation, sc.COOPERATION_EXCLUSIONS)} AS cooperation,
  {less(scorer.hostility, sc.HOSTILITY_EXCLUSIONS)} AS hostility, {count(scorer.labels)} AS labels, {less(mild, sc.MILD_EXCLUSIONS)} AS mild, {count(strong)} AS strong, {count(slurs)} AS slurs,
  CASE WHEN list_contains(t, '{sc.PARTY_LABEL_WORD}') THEN len(regexp_extract_all(s, '{sc.PARTY_LABEL}')) ELSE 0 END AS party_label
  FROM (SELECT *, regexp_extract_all(s, '{TOKEN_SQL}') AS t FROM strings)),
whole AS (SELECT *, courtesy + gratitude + cooperation AS comity FROM counted LEFT JOIN misconduct USING ({key})),
scores AS (SELECT doc_id, {pick("low", "n_words")} AS n_words, {pick("low", "courtesy")} AS formal_courtesy_hits, {pick("low", "gratitude")} AS gratitude_praise_hits, {pick("low", "cooperation")} AS cooperation_hits,
  {pick("low", "hostility")} AS hostility_hits, {pick("low", "misconduct")} AS misconduct_hits, {pick("low", "mild + strong")} AS profanity_hits, {pick("low", "comity")} AS comity_hits,
  {pick("low", "labels")} AS ideological_label_hits, {pick("low", "mild")} AS profanity_mild, {pick("low", "strong")} AS profanity_strong, {pick("low", "slurs")} AS profanity_slurs,
  count_if(kind = 'ctx')::BIGINT AS outgroup_refs, {pick("low", "party_label")} AS democrat_party_pej, {pick("win", "comity")} AS directed_comity_hits, {pick("win", "hostility")} AS directed_hostility_hits,
  {pick("win", "misconduct")} AS directed_misconduct_hits, {some("comity")} AS outgroup_comity_contexts, {some("hostility")} AS outgroup_hostility_contexts, {some("misconduct")} AS outgroup_misconduct_contexts
  FROM whole GROUP BY doc_id)"""


def sums() -> str:
    return ", ".join(f"sum({s})::BIGINT AS {s}" for s in sc.SCORES)


def raw_and_rates() -> str:
    """Select list of the metric table's raw counts and rates, over summed scores."""
    raw = [f"{m.score} AS {m.raw}" for m in METRICS]
    rate = [f"CASE WHEN {m.base} = 0 THEN 0.0 ELSE {m.score} * {float(m.scale)} / {m.base} END::DOUBLE AS {m.rate}" for m in METRICS]
    return ", ".join(raw + rate)
