"""Prefix trie, fill in the middle and nearest neighbours: brute force, edges and bounds."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fill_middle, neighbours, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, x long, salt int, length long, base long"


def py_trie(rows):
    """The trie by dictionaries of tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out = []
    for n, m in members.items():
        todo, leaves, saved = [n], 0, 0
        while todo:
            k = todo.pop()
            todo += children.get(k, [])
            leaves += k not in children
            saved += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        ended = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def spark_trie(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CONVERSATIONS)
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.read_turns(frame))).collect()
    return sorted([tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in found], key=str)


def test_trie_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(-12, 60), 10**12]:
        if c % 7 == 3:
            continue
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, "user" if turn % 2 == 0 else None, rng.choice(["a", "ß", "", None, "long text here"])))
    rows += [(4, None, "system", "first"), (4, 1, "x", "tie"), (4, 1, "x", "tie"), (None, 0, "user", "no id"), (None, 1, None, None)]
    assert spark_trie(spark, rows) == py_trie(rows)


def test_trie_of_many_copies_and_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 50)
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)] + [(5_000, t, "u", f"w{t % 9}") for t in range(600)]
    assert spark_trie(spark, rows) == py_trie(rows)


def test_trie_of_nothing(spark):
    assert spark_trie(spark, []) == [] and spark_trie(spark, [(None, 1, "a", "b")]) == []
    turnless = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 >= 1)
    (only,) = spark_trie(spark, [(turnless, 0, "user", "hello")])
    assert only == (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())


def test_trie_windows_split_hot_nodes(spark):
    """No group of either window holds more than a small share of the members of one node."""
    rows = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(1).alias("depth"), F.lit(7).alias("x"), F.lit(7).alias("y"), F.lit(3).alias("tokens"), F.lit(1).alias("length"))
    found = prefix_trie.owned(rows)
    assert found.filter("owned").collect()[0]["conv_id"] == 0 and found.filter("owned").count() == 1 and found.filter("leaf").count() == 1
    sizes = rows.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(prefix_trie.SALTS))).count().agg(F.max("count")).first()[0]
    assert sizes < 200


def py_fill(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", f"<P>{p}<S>{s}<M>{m}")


FILL_TEXTS = [None, "", "a", "𝒳", "a𝒳b🎉c", "e\u0301\u200d", "x<P>y", "<S>", "a<M>", "<P <S <M>", "<P", "line\r\nnext\n\n", " \t ", "word " * 40_000, *[f"text number {i} ends. Or not?" for i in range(80)]]


def test_fill_equals_brute_force(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(FILL_TEXTS)] + [(3, "𝒳", "c", 1), (-5, "negative id", "c", 1)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, fim_output string, fim_n int"))
    back = made.withColumn("back", fill_middle.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    assert sorted((r["doc_id"], r["fim_n"], r["fim_form"], r["fim_output"]) for r in back) == sorted((i, *py_fill(i, t)) for i, t, *_ in rows)
    assert all(r["back"] == (r["text"] or "") for r in back) and len({r["fim_form"] for r in back}) == 3
    assert made.columns == ["doc_id", "text", *fill_middle.COLUMNS]


@pytest.mark.parametrize("unit", sorted(fill_middle.GRAMMARS))
def test_every_grammar_loses_nothing(spark, unit):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(FILL_TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("u", fill_middle.units(F.coalesce("text", F.lit("")), fill_middle.GRAMMARS[unit]))
    made = fill_middle.fill_in_middle(frame, unit).withColumn("back", fill_middle.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(made) == len(rows)
    for r in made:
        assert r["back"] == (r["text"] or "") == "".join(r["u"]) and r["fim_n"] == len(r["u"]) and "" not in r["u"]
        if r["fim_form"] != "plain":
            for cut in (len(r["fim_prefix"]), len(r["fim_prefix"] + r["fim_middle"])):
                assert cut in {0, *np.cumsum([len(u) for u in r["u"]]).tolist()}
    assert fill_middle.fill_in_middle(frame.limit(0), unit).count() == 0


def test_grammars_cut_where_they_say(spark):
    cut = lambda text, unit: spark.range(1).select(fill_middle.units(F.lit(text), fill_middle.GRAMMARS[unit])).first()[0]
    assert cut("if x:\n  y = 1\n", "line") == ["if x:\n", "  y = 1\n"]
    assert cut("one  two\nthree", "word") == ["one  ", "two\n", "three"]
    assert cut("Is it? Yes. 3.5 is!", "sentence") == ["Is it? ", "Yes. ", "3.5 is!"]
    assert cut("f(x)  = y1;", "token") == ["f", "(", "x", ")", "  ", "=", " ", "y1", ";"]


def py_nearest(rows, k=20):
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for n, i, v in good:
        if i % 20 == 0:
            scored = [(-float(sum(a * b for a, b in zip(v, w, strict=True))), j) for m, j, w in good if m != n and len(w) == len(v)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def spark_nearest(spark, rows, kind="float", k=20):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, row long, down int")
    return sorted(tuple(r) for r in neighbours.nearest(frame, F.col("id") % 20 == 0, k=k).collect())


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 150)
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 60)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12)).astype(np.float32)
    vectors[200:450] = vectors[200]  # copies: ties go to the smaller id
    vectors[500:520] *= 1e6
    vectors[520:540] *= 1e-20
    vectors[540:560] = vectors[540] + rng.normal(size=(20, 12)).astype(np.float32) * 1e-6
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(700, None), (701, []), (720, [0.0] * 12), (721, [None] + [1.0] * 11), (722, [math.nan] + [1.0] * 11), (740, [math.inf] + [1.0] * 11), (None, [1.0] * 12)]
    rows += [(760, [1.0, 2.0]), (761, [2.0, 1.0]), (0, rows[0][1]), (40, rows[300][1])]
    assert spark_nearest(spark, rows) == py_nearest(rows)


def test_neighbours_of_few_and_of_none(spark):
    few = [(i, [float(i + 1), -1.0]) for i in range(5)]
    assert spark_nearest(spark, few, "double") == py_nearest(few) and len(py_nearest(few)) == 4
    assert spark_nearest(spark, []) == [] and spark_nearest(spark, [(1, [1.0])]) == [] and spark_nearest(spark, [(20, [1.0])]) == []
    assert spark_nearest(spark, [(20, [1]), (21, [2])], "int", 1) == [(20, 1, 21, 2.0)]


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(9)
    for scale in (1.0, 1e-150, 1e30):
        a, b = rng.normal(size=(50, 1500)) * scale, rng.normal(size=(60, 1500))
        ca, sa, _, ma, ea = neighbours.quantise(a)
        cb, sb, nb, _, eb = neighbours.quantise(b)
        assert (neighbours.code_products(ca, cb) == ca.astype(np.int64) @ cb.astype(np.int64).T).all()
        error = np.abs(a @ b.T - neighbours.code_products(ca, cb) * sa[:, None] * sb[None, :])
        bound = ea[:, None] * nb[None, :] + ma[:, None] * eb[None, :]
        assert (error <= bound * (1 + 1e-9)).all() and bound.max() < 0.05 * np.abs(np.linalg.norm(a, axis=1)[:, None] * nb[None, :]).max()


def test_tiles_discard_what_cannot_be_near(monkeypatch):
    """Most pairs end at their bounds; exact products are of few."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    pairs = []
    exact = neighbours.exact_products
    monkeypatch.setattr(neighbours, "exact_products", lambda a, b: pairs.append(len(a)) or exact(a, b))
    rows = np.arange(len(v))
    neighbours.search_tile((rows[:100], rows[:100], v[:100]), (rows, rows, v), 20)
    assert sum(pairs) < 0.03 * 100 * len(v)
